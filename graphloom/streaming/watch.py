"""Incremental maintenance with Structured Streaming.

The latest content of each file wins. A micro-batch compares hashes with the store, parses the files that changed, links
them and what they touch, and writes a new version; events come first, the pointer last, and the number of the batch is
part of the version, so a crash at any point leaves the version before and the replay does it all again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import diff_symbols
from ..plans.build import build, rebuild
from ..sources.parse import parse
from ..storage import GraphStore, cut, empty


def latest(batch: DataFrame) -> DataFrame:
    """Row 309: one record a file, the last by mtime; content null is a removal."""
    return batch.groupBy("file").agg(F.max_by(F.struct("content", "hash", "mtime", "size"), F.struct("mtime", "hash")).alias("x")).select("file", "x.*")


def apply_batch(store: GraphStore, batch: DataFrame, batch_id: int, sources: str) -> None:
    """Rows 312-317: nothing is done for a batch that was applied, or whose files are all as they were; sources holds the
    folder of events. A store without facts, as an interrupted first build leaves it, is built from the batch."""
    state = store.state()
    if batch_id <= state.get("last_batch", -1):
        return
    fresh = cut(latest(batch))
    known = store.read("file_hashes")
    was = known.select("file", F.col("hash").alias("was"))
    removed = fresh.filter("content IS NULL").join(was, "file", "left_semi").select("file")
    written = fresh.filter("content IS NOT NULL").join(was, "file", "left").filter("was IS NULL OR was <> hash").drop("was")
    changed = cut(removed.unionByName(written.select("file")))
    state = state | {"last_batch": batch_id}
    if changed.isEmpty():
        store.write({}, f"v-{batch_id}", state)
        return
    written = fresh.join(changed.join(removed, "file", "left_anti"), "file", "left_semi")
    facts = cut(parse(written))
    before = store.read("nodes")
    files = known.join(changed, "file", "left_anti").unionByName(written.select("file", "hash", "mtime", "size"))
    if store.version() is None:
        tables = build(written, facts)
    else:
        old = {t: store.read(t) for t in ("nodes", "edges", "facts", "dataflow", "function_complexity", "cfg_blocks", "cfg_edges", "ast_nodes")}
        tables = rebuild(old, files, changed, facts)
    events(before, tables["nodes"], changed).write.mode("overwrite").json(f"{sources}/events/batch={batch_id}")
    store.write(tables, f"v-{batch_id}", state)


def append_journal(store: GraphStore, entries: DataFrame, stamp: int) -> None:
    """Rows 319-320: entries (file, removed) of one moment, in a folder of the journal named by it; written again, they are
    the same."""
    entries.select("file", "removed").write.mode("overwrite").parquet(f"{store.root}/journal/seq={stamp}")


def read_journal(store: GraphStore, since: int = -1) -> DataFrame:
    """(file, removed, seq) of the journal's entries after a moment."""
    path, fs = store._path(f"{store.root}/journal")
    if not fs.exists(path):
        return empty(store.spark, "file string, removed boolean, seq int")
    return store.spark.read.parquet(f"{store.root}/journal").filter(F.col("seq") > since)


def expire_events(store: GraphStore, sources: str, keep: int = 100) -> int:
    """Row 38: the events of all but the last `keep` batches go; returns how many folders did."""
    path, fs = store._path(f"{sources}/events")
    last, gone = store.state().get("last_batch", -1), 0
    for status in fs.listStatus(path) if fs.exists(path) else ():
        number = status.getPath().getName().removeprefix("batch=")
        if number.isdigit() and int(number) <= last - keep:
            gone += bool(fs.delete(status.getPath(), True))
    return gone


def drift(store: GraphStore, files: DataFrame) -> DataFrame:
    """Row 318: (file, drift): where the store and the files (file, hash) that there are differ: missing, stale, removed."""
    known = store.read("file_hashes").select("file", F.col("hash").alias("was"))
    state = F.when(F.col("was").isNull(), "missing").when(F.col("hash").isNull(), "removed").when(F.col("was") != F.col("hash"), "stale")
    return files.select("file", "hash").join(known, "file", "full").select("file", state.alias("drift")).filter("drift IS NOT NULL")


def events(before: DataFrame, after: DataFrame, changed: DataFrame) -> DataFrame:
    """Rows 155, 321: a row a changed symbol of the changed files."""
    own = lambda df: df.join(changed.select("file"), "file", "left_semi").filter("kind <> 'file'").select(F.concat_ws("::", "file", "name").alias("name"), "kind", "line")
    return diff_symbols(own(before), own(after))


def watch(stream: DataFrame, store: GraphStore, sources: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Row 308: stream has (file, content, hash, mtime, size)."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: apply_batch(store, df, i, sources))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed_counts(events_: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Changes a type and window of event time; late rows beyond the watermark are dropped by Spark."""
    return events_.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def poll(store: GraphStore, files: DataFrame, sources: str) -> bool:
    """Row 310: one turn of a polling watcher without a stream: files is a scan (file, content, hash, mtime, size) of the
    whole tree; what differs from the store becomes the next batch. Says whether anything did."""
    differs = cut(drift(store, files))
    if differs.isEmpty():
        return False
    gone = differs.filter("drift = 'removed'").select("file", F.lit(None).cast("binary").alias("content"), F.lit("").alias("hash"), F.lit(0).cast("long").alias("mtime"), F.lit(0).cast("long").alias("size"))
    batch = files.join(differs.select("file"), "file", "left_semi").select("file", "content", "hash", "mtime", "size").unionByName(gone)
    apply_batch(store, batch, store.state().get("last_batch", -1) + 1, sources)
    return True

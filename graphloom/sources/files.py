"""File, git and CODEOWNERS sources."""

from __future__ import annotations

import re
import subprocess

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..schema import LANGUAGE_OF

IGNORED = ("node_modules", ".git", "dist", "build", "coverage", "vendor", "__pycache__", ".venv", "target")


def ignore_rule(line: str, base: str = "") -> tuple[str, bool] | None:
    """(regular expression of paths, ignored) of a line of an ignore file in directory base; None for blank and comments."""
    text = line.rstrip()
    if not text or text.startswith("#"):
        return None
    keep = text.startswith("!")
    text = text.removeprefix("!").removeprefix("\\")
    only_dirs, anchored = text.endswith("/"), "/" in text.rstrip("/")
    body = S.glob_regex(text.strip("/")).removeprefix("^").removesuffix("$")
    head = re.escape(base + "/") if base else ""
    return f"^{head}{'' if anchored else '(?:.*/)?'}{body}{'/' if only_dirs else '(?:/|$)'}", not keep


def ignored(path: str, rules: list[tuple[str, bool]]) -> bool:
    """The last rule that matches decides."""
    return next((out for rule, out in reversed(rules) if re.search(rule, path)), False)


def _bytes(spark: SparkSession, status) -> bytes:
    """The content of a small file that Spark's readers pass over as hidden, by way of the driver."""
    context = spark.sparkContext
    stream = status.getPath().getFileSystem(context._jsc.hadoopConfiguration()).open(status.getPath())
    try:
        return bytes(context._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def walk(spark: SparkSession, root: str) -> tuple[list[str], list[tuple[str, bool]], list]:
    """Row 2: the directories below root that are no build products and not ignored, the rules of all ignore files, and the
    status of files that Spark passes over: empty ones, and those that start with an underscore. The tree is listed by Hadoop's file system, so root may be on any
    store; links to a directory seen before are left out."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top = fs.makeQualified(top)
    base = str(top.toUri().getPath()).rstrip("/")
    todo, out, rules, seen, passed_over = [top], [], [], set(), []
    while todo:
        path = todo.pop()
        real = jvm.java.io.File(path.toUri().getPath()).getCanonicalPath() if fs.getScheme() == "file" else str(path)
        if real in seen:
            continue
        seen.add(real)
        out.append(str(path))
        own = str(path.toUri().getPath())[len(base) :].strip("/")
        entries = list(fs.listStatus(path))
        for e in entries:
            if e.getPath().getName() == ".gitignore" and e.isFile():
                rules += [r for line in _bytes(spark, e).decode("utf-8", "replace").splitlines() if (r := ignore_rule(line, own))]
        passed_over += [e for e in entries if e.isFile() and (e.getPath().getName().startswith("_") or not e.getLen())]
        for e in entries:
            name = e.getPath().getName()
            if e.isDirectory() and name not in IGNORED and not ignored(f"{own}/{name}/".lstrip("/"), rules):
                todo.append(e.getPath())
    return out, rules, passed_over


_READ = "path string, content binary, mtime long, size long"


def _passed_over(spark: SparkSession, found: list, most: int = 64 << 20) -> DataFrame | None:
    """Files such as __init__.py, which Spark's readers take for hidden ones: read by way of the driver, at most so many
    bytes at a time."""
    from ..storage import cut

    parts, rows, size = [], [], 0
    for i, e in enumerate(found):
        content = _bytes(spark, e)
        rows.append((str(e.getPath()), bytearray(content), e.getModificationTime(), len(content)))
        size += len(content)
        if size >= most or i == len(found) - 1:
            parts.append(cut(spark.createDataFrame(rows, _READ)))
            rows, size = [], 0
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def scan_tree(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), extensions: list[str] | None = None) -> DataFrame:
    """Rows 1-2, 4: (file, content, hash, mtime, size) of source files below root, paths relative to it, '/' as separator.
    Ignored directories are not listed at all."""
    base = root.rstrip("/")
    folders, rules, passed_over = walk(spark, base)
    known = extensions or list(LANGUAGE_OF)
    raw = spark.read.format("binaryFile").load(folders).select("path", "content", F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"))
    more = _passed_over(spark, [e for e in passed_over if any(e.getPath().getName().lower().endswith(x) for x in known)])
    raw = raw if more is None else raw.unionByName(more)
    path = F.regexp_replace("path", r"^[a-z]+:/*", "/")
    file = F.expr("substring(p, locate(b, p) + length(b) + 1)")
    rows = raw.withColumn("p", path).withColumn("b", F.lit(re.sub(r"^[a-z]+:/*", "/", base))).withColumn("file", file)
    out = F.lit(False)
    for rule, hides in rules:
        out = F.when(F.col("file").rlike(rule), hides).otherwise(out)
    kept = rows.filter(S.extension(F.col("file")).isin(*known) & ~out & S.passes(F.col("file"), include, exclude))
    return kept.select("file", "content", F.sha2("content", 256).alias("hash"), "mtime", "size")


def fast_collect(known: DataFrame, journal: DataFrame) -> DataFrame:
    """Row 3: (file) without a walk: the files that the store knows, with what the journal (file, removed, seq) has added
    since and without what it has removed; of several entries of a file the last counts."""
    last = journal.groupBy("file").agg(F.max_by("removed", "seq").alias("removed"))
    return known.select("file").unionByName(last.filter("NOT removed").select("file")).distinct().join(last.filter("removed").select("file"), "file", "left_anti")


def declaration_hashes(defs: DataFrame, files: DataFrame) -> DataFrame:
    """Row 10: (file, name, line, content_hash) of each definition's own lines."""
    lines = files.select("file", F.split(F.decode("content", "UTF-8"), "\n").alias("ls"))
    body = F.array_join(F.expr("slice(ls, line, greatest(1, coalesce(end_line, line) - line + 1))"), "\n")
    return defs.join(lines, "file").select("file", "name", "line", F.sha2(body.cast("binary"), 256).alias("content_hash"))


def source_range(files: DataFrame, file: str, start: int, end: int) -> DataFrame:
    """Row 366."""
    rows = files.filter(F.col("file") == file).select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("i", "text"))
    return rows.filter((F.col("i") + 1).between(start, end)).select((F.col("i") + 1).alias("line"), "text")


def parse_git_log(log: DataFrame, column: str = "value") -> DataFrame:
    """Row 12: rows of blocks `sha, epoch, files...` (one a line, as from --name-only --pretty=%H%n%at) to commits."""
    lines = F.filter(F.split(F.trim(F.col(column)), r"\n"), lambda x: x != "")
    rows = log.select(lines.alias("ls")).filter("size(ls) > 2")
    rows = rows.select(F.col("ls")[0].alias("sha"), F.try_to_number(F.col("ls")[1], F.lit("999999999999")).cast("long").alias("epoch"), F.transform(F.expr("slice(ls, 3, size(ls))"), lambda f: F.replace(f, F.lit("\\"), F.lit("/"))).alias("files"))
    return rows.filter("epoch IS NOT NULL")


def scan_git_history(spark: SparkSession, repo: str, since: str | None = None) -> DataFrame:
    """Row 11: one local git process; its output is split into commits on the cluster."""
    args = ["git", "-C", repo, "log", "--name-only", "--no-merges", "--pretty=format:%H%n%at", *([f"--since={since}"] if since else []), "--", "."]
    out = subprocess.run(args, capture_output=True, text=True, check=True).stdout
    blocks = [(b,) for b in re.split(r"\n\n+", out.strip()) if b]
    return parse_git_log(spark.createDataFrame(blocks, "value string"))


def git_diff(repo: str, ref: str | None = None, staged: bool = False) -> str:
    """Row 13."""
    return subprocess.run(["git", "-C", repo, "diff", "--unified=0", "--no-color", *(["--cached"] if staged else []), *([ref] if ref else [])], capture_output=True, text=True, check=True).stdout


def parse_diff(text: str) -> list[dict]:
    """Rows 14-15: a row a hunk: file, old_start, old_stop, start, stop, removed, added, new_file, deleted_file."""
    out, file, old, new_file, hunk = [], None, None, False, None
    for line in text.splitlines():
        if line.startswith("diff --git"):
            new_file, hunk = False, None
        elif line.startswith("new file mode"):
            new_file = True
        elif line.startswith("--- ") and hunk is None:
            old = None if line[4:] == "/dev/null" else line[6:]
        elif line.startswith("+++ ") and hunk is None:
            file = None if line[4:] == "/dev/null" else line[6:]
        elif m := re.match(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line):
            a, n, b, k = int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)
            hunk = {"file": file or old, "old_start": a, "old_stop": a + max(n, 1) - 1, "start": b, "stop": b + max(k, 1) - 1, "removed": "", "added": "", "new_file": new_file, "deleted_file": file is None}
            out.append(hunk)
        elif hunk is not None and line[:1] in "+-":
            hunk["added" if line[0] == "+" else "removed"] += line[1:] + "\n"
    return out


HUNK = "file string, old_start int, old_stop int, start int, stop int, removed string, added string, new_file boolean, deleted_file boolean"


def diff_hunks(diffs: DataFrame, column: str = "value") -> DataFrame:
    """Row 15 over a DataFrame of diffs, one diff a row."""

    def run(frames):
        for frame in frames:
            rows = [h for text in frame[column] for h in parse_diff(text or "")]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HUNK.split(", ")])

    return diffs.select(column).mapInPandas(run, HUNK)

"""Graph export and sinks: one line a row, so writers stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _quoted(c) -> F.Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def _xml(c) -> F.Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def dot(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Row 335: (line) of the statements between `digraph {` and `}`."""
    return pairs.select(F.concat(F.lit("  "), _quoted(F.col(source)), F.lit(" -> "), _quoted(F.col(target)), F.lit(";")).alias("line"))


def mermaid(pairs: DataFrame, source: str, target: str) -> DataFrame:
    """Row 336."""
    node = lambda c: F.concat(F.lit("n"), F.substring(F.md5(F.col(c)), 1, 8), F.lit("["), _quoted(F.col(c)), F.lit("]"))
    return pairs.select(F.concat(F.lit("  "), node(source), F.lit(" --> "), node(target)).alias("line"))


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Row 337: one JSON object a node or edge, with its type."""
    n = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), *nodes.columns)).alias("line"))
    return n.unionByName(edges.select(F.to_json(F.struct(F.lit("edge").alias("type"), *edges.columns)).alias("line")))


def graphml(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Row 338: (line) of the elements inside <graph>."""
    data = lambda k: F.concat(F.lit(f'<data key="{k}">'), _xml(F.coalesce(F.col(k).cast("string"), F.lit(""))), F.lit("</data>"))
    n = nodes.select(F.concat(F.lit('<node id="n'), F.col("id"), F.lit('">'), data("name"), data("kind"), data("file"), F.lit("</node>")).alias("line"))
    e = edges.select(F.concat(F.lit('<edge source="n'), F.col("source_id"), F.lit('" target="n'), F.col("target_id"), F.lit('">'), data("kind"), F.lit("</edge>")).alias("line"))
    return n.unionByName(e)


def graphson(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Row 339: one GraphSON vertex a line, with its out-edges grouped."""
    out = edges.groupBy(F.col("source_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("kind").alias("label"), F.col("target_id").alias("inV")))).alias("outE"))
    rows = nodes.join(out, "id", "left")
    return rows.select(F.to_json(F.struct("id", F.col("kind").alias("label"), F.struct("name", "file", "line").alias("properties"), F.coalesce("outE", F.array()).alias("outE"))).alias("line"))


def neo4j_nodes(nodes: DataFrame) -> DataFrame:
    """Row 340: columns as the bulk importer names them; write with header."""
    return nodes.select(F.col("id").alias("nodeId:ID"), "name", "file", F.col("line").alias("line:int"), F.col("kind").alias(":LABEL"))


def neo4j_relationships(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("source_id").alias(":START_ID"), F.col("target_id").alias(":END_ID"), F.upper(F.replace("kind", F.lit("-"), F.lit("_"))).alias(":TYPE"), F.col("confidence").alias("confidence:float"))


def directory_groups(files: DataFrame) -> DataFrame:
    """Row 334: (directory, files)."""
    from ..functions.scalars import directory

    return files.select(directory(F.col("file")).alias("directory"), "file").distinct().groupBy("directory").agg(F.array_sort(F.collect_list("file")).alias("files"))


def sequence_messages(steps: DataFrame, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row 179: (depth, from_file, to_file, message): one message for each caller and callee of a flow's levels."""
    n = nodes.select("id", "name", "file")
    one = edges.select("source_id", "target_id").distinct()
    rows = steps.select(F.col("node").alias("source_id"), "depth").join(one, "source_id").join(steps.select(F.col("node").alias("target_id")).distinct(), "target_id")
    rows = rows.join(n.select(F.col("id").alias("source_id"), F.col("file").alias("from_file")), "source_id").join(n.select(F.col("id").alias("target_id"), F.col("file").alias("to_file"), F.col("name").alias("message")), "target_id")
    return rows.select("depth", "from_file", "to_file", "message").distinct()


def sequence_mermaid(messages: DataFrame) -> DataFrame:
    """Row 418: lines (at, line) of a Mermaid sequence diagram of sequence_messages(): participants, then messages by depth."""
    who = lambda c: F.concat(F.lit("p"), F.hex(F.xxhash64(c)))
    files = messages.select(F.explode(F.array("from_file", "to_file")).alias("file")).distinct()
    head = messages.sparkSession.createDataFrame([("0", "sequenceDiagram")], "at string, line string")
    rows = head.unionByName(files.select(F.concat(F.lit("1"), "file").alias("at"), F.concat(F.lit("    participant "), who("file"), F.lit(" as "), "file").alias("line")))
    place = F.concat(F.lit("2"), F.lpad(F.col("depth").cast("string"), 9, "0"), "from_file", "to_file", "message")
    return rows.unionByName(messages.select(place.alias("at"), F.concat(F.lit("    "), who("from_file"), F.lit("->>"), who("to_file"), F.lit(": "), "message").alias("line")))


def function_edges(edges: DataFrame, nodes: DataFrame, min_confidence: float = 0.0) -> DataFrame:
    """Row 333: (source_name, source_file, target_name, target_file, kind, confidence) of calls between symbols, each pair
    of symbols once, with its surest call."""
    from .lookup import with_ends

    own = with_ends(edges.filter("kind = 'calls'"), nodes, "name", "file").filter(F.coalesce("confidence", F.lit(0.0)) >= min_confidence)
    best = own.groupBy("source_id", "target_id", "source_name", "source_file", "target_name", "target_file", "kind").agg(F.max("confidence").alias("confidence"))
    return best.drop("source_id", "target_id")


def aliases(files: list[str]) -> dict[str, str]:
    """Row 180: the shortest trailing path, up to ten segments, that no other file shares; else the whole path."""
    out = {f: f for f in files}
    for n in range(10, 0, -1):
        short = ["/".join(f.split("/")[-n:]) for f in files]
        if len(set(short)) == len(files):
            out = dict(zip(files, short))
    return out


_PAGE = """<!DOCTYPE html><meta charset="utf-8"><title>Graph</title><svg id="g" viewBox="-520 -520 1040 1040" style="width:100%;height:95vh"></svg><script>
const d=DATA,s=document.getElementById("g"),at={},n=d.nodes.length;const put=(t,a,x)=>{const e=document.createElementNS("http://www.w3.org/2000/svg",t);for(const k in a)e.setAttribute(k,a[k]);if(x)e.append(x);s.append(e)};
d.nodes.forEach((v,i)=>at[v.id]=[480*Math.cos(6.2832*i/n),480*Math.sin(6.2832*i/n)]);d.edges.forEach(([a,b])=>put("line",{x1:at[a][0],y1:at[a][1],x2:at[b][0],y2:at[b][1],stroke:"#bbb","stroke-width":.5}));
d.nodes.forEach(v=>{put("circle",{cx:at[v.id][0],cy:at[v.id][1],r:2+Math.min(10,v.degree/3),fill:"#47a"});put("text",{x:at[v.id][0]+4,y:at[v.id][1],"font-size":9},v.name)})</script>
"""


def html_page(nodes: DataFrame, edges: DataFrame, limit: int = 300) -> str:
    """Row 419: one page that draws the `limit` symbols with most edges and the edges among them."""
    import json

    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    top = ends.join(nodes.select("id", "name"), "id").orderBy(F.col("degree").desc(), "id").limit(limit)
    own = [r.asDict() for r in top.collect()]
    ids = nodes.sparkSession.createDataFrame([(r["id"],) for r in own], f"id {dict(nodes.dtypes)['id']}")
    inner = edges.select("source_id", "target_id").distinct().join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    drawn = [[r.source_id, r.target_id] for r in inner.collect()]  # at most limit * limit
    return _PAGE.replace("DATA", json.dumps({"nodes": own, "edges": drawn}).replace("<", "\\u003c"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def write_ndjson(df: DataFrame, path: str) -> None:
    """Rows 40, 420."""
    df.write.mode("overwrite").json(path)

"""Dataflow and control flow over stored facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .traverse import reach, shortest_path


def dataflow(facts: DataFrame, nodes: DataFrame, function_id: int) -> DataFrame:
    """Row 262: (direction, kind, other, expression, line): facts at a function, both ways."""
    names = nodes.select(F.col("id").alias("other_id"), F.col("name").alias("other"))
    side = lambda here, there, label: facts.filter(F.col(here) == function_id).select(F.lit(label).alias("direction"), "kind", F.col(there).alias("other_id"), "expression", "line")
    return side("source_id", "target_id", "out").unionByName(side("target_id", "source_id", "in")).join(names, "other_id").drop("other_id")


def dataflow_path(facts: DataFrame, source: int, target: int, max_depth: int = 10) -> DataFrame:
    """Row 263."""
    return shortest_path(facts.filter(F.col("kind").isin("flows_to", "returns")), source, target, max_depth)


def dataflow_impact(facts: DataFrame, roots: DataFrame, max_depth: int = 5) -> DataFrame:
    """Row 264: who uses what a function returns, by depth."""
    own = facts.filter("kind = 'returns'").select("source_id", "target_id")
    return reach(own, roots.select(F.col("id").alias("root"), F.col("id").alias("node")), max_depth).filter("depth > 0")


def summaries(vertices: DataFrame, flows: DataFrame) -> DataFrame:
    """Row 265: (func_id, param_index, flows_to_return, is_mutated): flows has (source, target, kind) between vertices."""
    params = vertices.filter("kind = 'param'").select(F.col("id").alias("vertex"), "func_id", "param_index")
    inside = reach(flows.filter("kind = 'def_use'").select(F.col("source").alias("source_id"), F.col("target").alias("target_id")), params.select(F.col("vertex").alias("root"), F.col("vertex").alias("node")))
    returns = vertices.filter("kind = 'return'").select(F.col("id").alias("node"), F.col("func_id").alias("rf"))
    to_return = inside.join(returns, "node").join(params.select(F.col("vertex").alias("root"), "func_id"), "root").filter("rf = func_id").select(F.col("root").alias("vertex")).distinct().withColumn("r", F.lit(True))
    mutated = flows.filter("kind = 'mutates'").select(F.col("source").alias("vertex")).distinct().withColumn("m", F.lit(True))
    rows = params.join(to_return, "vertex", "left").join(mutated, "vertex", "left")
    return rows.select("func_id", "param_index", F.col("r").isNotNull().alias("flows_to_return"), F.col("m").isNotNull().alias("is_mutated"))


def stitch(arguments: DataFrame, captures: DataFrame, vertices: DataFrame, summary: DataFrame) -> DataFrame:
    """Row 266: interprocedural edges (source, target, kind).

    arguments (caller, callee, param_index, vertex) give arg_in edges to the callee's parameter; captures (caller,
    callee, vertex), the first of each pair, give return_out edges where a parameter flows to the return.
    """
    params = vertices.filter("kind = 'param'").select(F.col("func_id").alias("callee"), "param_index", F.col("id").alias("param"))
    arg_in = arguments.join(params, ["callee", "param_index"]).select(F.col("vertex").alias("source"), F.col("param").alias("target"), F.lit("arg_in").alias("kind"))
    first = captures.withColumn("n", F.row_number().over(W.partitionBy("caller", "callee").orderBy("vertex"))).filter("n = 1").select("caller", "callee", F.col("vertex").alias("captured"))
    returns = vertices.filter("kind = 'return'").select(F.col("func_id").alias("callee"), F.col("id").alias("ret"))
    flowing = summary.filter("flows_to_return").select(F.col("func_id").alias("callee")).distinct()
    out = first.join(flowing, "callee").join(returns, "callee").select(F.col("ret").alias("source"), F.col("captured").alias("target"), F.lit("return_out").alias("kind"))
    return arg_in.unionByName(out).distinct()


def cfg(blocks: DataFrame, flow: DataFrame, function_id: int) -> tuple[DataFrame, DataFrame]:
    """Rows 270, 359-360: a function's blocks, and its edges with the types of their ends."""
    b = blocks.filter(F.col("function_id") == function_id)
    ends = [b.select(F.col("block_index").alias(f"{e}_block"), F.col("block_type").alias(f"{e}_type")) for e in ("source", "target")]
    return b, flow.filter(F.col("function_id") == function_id).join(ends[0], "source_block").join(ends[1], "target_block")


def cfg_dot(blocks: list, flow: list, mermaid: bool = False) -> str:
    """Rows 273, 389: text of one function's graph; blocks are (index, type, start, end), edges (source, target, kind)."""
    lines = ["graph TD" if mermaid else "digraph cfg {"]
    for i, kind, start, end in blocks:
        where = f"{kind} {start}-{end}" if start else kind
        lines.append(f"  B{i}[{where}]" if mermaid else f'  B{i} [label="{where}"];')
    for a, b, kind in flow:
        lines.append(f"  B{a} -->|{kind}| B{b}" if mermaid else f'  B{a} -> B{b} [label="{kind}"];')
    return "\n".join(lines + ([] if mermaid else ["}"]))

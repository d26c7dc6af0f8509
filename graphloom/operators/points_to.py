"""Points-to analysis: inclusion constraints solved to a fixpoint, one task a file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_ITERATIONS = 50


def solve(bindings: list[tuple[str, str]], definitions: set[str], max_iterations: int = MAX_ITERATIONS) -> dict[str, set[str]]:
    """pts(lhs) includes pts(rhs) for every binding (lhs, rhs); a definition points to itself."""
    pts: dict[str, set[str]] = {d: {d} for d in definitions}
    for _ in range(max_iterations):
        moved = False
        for lhs, rhs in bindings:
            gained = pts.get(rhs, set()) - pts.setdefault(lhs, set())
            if gained:
                pts[lhs] |= gained
                moved = True
        if not moved:
            break
    return pts


def points_to(bindings: DataFrame, definitions: DataFrame, max_iterations: int = MAX_ITERATIONS) -> DataFrame:
    """(file, name, target): bindings has (file, lhs, rhs), definitions (file, name). Names that only point to themselves
    are left out. A file's own bindings bound its group."""
    rows = bindings.select("file", "lhs", "rhs").unionByName(definitions.select("file", F.col("name").alias("lhs"), F.lit(None).cast("string").alias("rhs")))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        known = set(frame.loc[frame["rhs"].isna(), "lhs"])
        pairs = list(frame.loc[frame["rhs"].notna(), ["lhs", "rhs"]].sort_values(["lhs", "rhs"]).itertuples(index=False, name=None))
        found = [(frame["file"].iloc[0], n, t) for n, ts in solve(pairs, known, max_iterations).items() for t in sorted(ts) if t != n]
        return pd.DataFrame(found, columns=["file", "name", "target"])

    return rows.groupBy("file").applyInPandas(run, "file string, name string, target string")


def resolve(calls: DataFrame, found: DataFrame) -> DataFrame:
    """Row 405: calls (file, name, ...) with each target that the name may stand for."""
    return calls.join(found, ["file", "name"])

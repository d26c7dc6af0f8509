"""Owners, boundaries and change checks."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .cycles import cycles
from .lookup import affected, effective_end, file_edges, with_ends
from .traverse import impact

PRESETS = {
    "hexagonal": ("domain", "application", "adapters"),
    "layered": ("data", "business", "presentation"),
    "clean": ("entities", "usecases", "interfaces", "frameworks"),
    "onion": ("domain-model", "domain-services", "application", "infrastructure"),
}


def parse_codeowners(text: str) -> list[tuple[str, str, list[str]]]:
    """Rows 16-18: (pattern, regex, owners) in order of the file."""
    out = []
    for line in text.splitlines():
        parts = line.split("#", 1)[0].split()
        if len(parts) > 1:
            out.append((parts[0], owner_regex(parts[0]), parts[1:]))
    return out


def owner_regex(pattern: str) -> str:
    """A leading or inner slash anchors; a trailing one means everything below; a bare name matches at any depth."""
    anchored = pattern.startswith("/") or "/" in pattern.rstrip("/")
    body = pattern.strip("/")
    glob = S.glob_regex(body)[1:-1]
    tail = "/.*" if pattern.endswith("/") else "(?:/.*)?"
    return f"^{'' if anchored else '(?:.*/)?'}{glob}{tail}$"


def file_owners(files: DataFrame, rules: list[tuple[str, str, list[str]]]) -> DataFrame:
    """Row 257: (file, owners): the last matching rule wins; null owners without one. Rules are a short list."""
    owners = F.lit(None).cast("array<string>")
    for _, regex, names in rules:
        owners = F.when(F.col("file").rlike(regex), F.array(*map(F.lit, names))).otherwise(owners)
    return files.select("file").distinct().withColumn("owners", owners)


def owners_summary(owned: DataFrame) -> DataFrame:
    """Row 132: (owner, files)."""
    return owned.select("file", F.explode("owners").alias("owner")).groupBy("owner").agg(F.countDistinct("file").alias("files"))


def owner_boundaries(edges: DataFrame, nodes: DataFrame, owned: DataFrame) -> DataFrame:
    """Row 97: calls between files of different sorted owner sets."""
    own = owned.select("file", F.array_join(F.array_sort(F.coalesce("owners", F.array().cast("array<string>"))), ",").alias("o"))
    rows = with_ends(edges.filter("kind = 'calls'").select("source_id", "target_id"), nodes, "name", "file")
    rows = rows.join(own.select(F.col("file").alias("source_file"), F.col("o").alias("source_owners")), "source_file").join(own.select(F.col("file").alias("target_file"), F.col("o").alias("target_owners")), "target_file")
    return rows.filter("source_owners <> target_owners").select("source_id", "target_id", "source_owners", "target_owners")


def preset_rules(modules: dict[str, dict], preset: str) -> list[dict]:
    """Row 214: modules of an inner layer must not depend on those of outer ones."""
    layers = {x: i for i, x in enumerate(PRESETS.get(preset, ()))}
    placed = {name: layers[m["layer"]] for name, m in modules.items() if m.get("layer") in layers}
    out = []
    for name, depth in placed.items():
        outer = [n for n, d in placed.items() if d > depth]
        if outer:
            out.append({"from": name, "not_to": outer})
    return out


def check_config(config: dict) -> list[str]:
    """Row 386: what is wrong with a boundary configuration."""
    modules = config.get("modules") or {}
    errors = [] if modules else ["no modules"]
    if config.get("preset") and config["preset"] not in PRESETS:
        errors.append(f"unknown preset {config['preset']}")
    for rule in config.get("rules", ()):
        errors += [f"unknown module {m}" for m in [rule.get("from"), *rule.get("not_to", ()), *rule.get("only_to", ())] if m not in modules]
    return errors


def classify_module(column, modules: dict[str, dict]):
    """Row 258: the first module whose glob matches."""
    out = F.lit(None).cast("string")
    for name, m in reversed(modules.items()):
        out = F.when(column.rlike(S.glob_regex(m["match"])), name).otherwise(out)
    return out


def boundary_violations(pairs: DataFrame, config: dict) -> DataFrame:
    """Row 215: (source_file, target_file, from_module, to_module, rule) of file edges that break a rule; rule counts from 0."""
    if errors := check_config(config):
        raise ValueError("; ".join(errors))
    modules = config["modules"]
    rules = (preset_rules(modules, config["preset"]) if config.get("preset") else []) + list(config.get("rules", ()))
    rows = pairs.withColumn("from_module", classify_module(F.col("source_file"), modules)).withColumn("to_module", classify_module(F.col("target_file"), modules)).filter("from_module IS NOT NULL AND to_module IS NOT NULL")
    broken = []
    for i, r in enumerate(rules):
        bad = F.lit(False)
        if r.get("not_to"):
            bad = bad | F.col("to_module").isin(*r["not_to"])
        if r.get("only_to") is not None:
            bad = bad | ~F.col("to_module").isin(*r["only_to"])
        broken.append(F.when((F.col("from_module") == r["from"]) & bad, i))
    found = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<int>")
    return rows.select("source_file", "target_file", "from_module", "to_module", F.explode(found).alias("rule"))


def check_cycles(pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """Row 216: file cycles that hold a changed file (file); pairs has (source_file, target_file)."""
    found = cycles(pairs.select(F.col("source_file").alias("source_id"), F.col("target_file").alias("target_id")))
    held = found.select("component", F.explode("members").alias("file")).join(changed.select("file"), "file", "left_semi")
    return found.join(held.select("component"), "component", "left_semi")


def check_blast_radius(nodes: DataFrame, edges: DataFrame, hunks: DataFrame, threshold: int, max_depth: int = 3) -> DataFrame:
    """Row 217: affected callables with more transitive callers than the threshold."""
    hit = affected(nodes, hunks).filter(F.col("kind").isin("function", "method", "class")).select("id")
    callers = impact(edges.filter("kind = 'calls'"), hit, max_depth).groupBy(F.col("root").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    return callers.filter(F.col("callers") > threshold)


def calls_in(text: str) -> set[str]:
    return set(re.findall(r"([A-Za-z_$][\w$]*)\s*\(", text or ""))


def call_shape_changed(removed: str, added: str) -> bool:
    """Row 218: whether an edit changes the set of names that are called."""
    return calls_in(removed) != calls_in(added)


def check_signatures(nodes: DataFrame, hunks: DataFrame) -> DataFrame:
    """Row 219: exported definitions whose own line is inside a changed range."""
    h = hunks.select(F.col("file").alias("hunk_file"), "start", "stop")
    return effective_end(nodes).filter("exported = 1").join(h, (F.col("file") == F.col("hunk_file")) & F.col("line").between(F.col("start"), F.col("stop")), "left_semi").select("id", "name", "file", "line")


def check_deleted_exports(nodes: DataFrame, edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows 220, 225: exported symbols of deleted files with consumers in files that stay; deleted has (file)."""
    rows = with_ends(edges.filter(F.col("kind").isin("calls", "imports", "imports-type")), nodes, "name", "file", "exported").filter("target_exported = 1")
    gone = rows.join(deleted.select(F.col("file").alias("target_file")), "target_file", "left_semi").join(deleted.select(F.col("file").alias("source_file")), "source_file", "left_anti")
    return gone.select(F.col("target_id").alias("id"), F.col("target_name").alias("name"), F.col("target_file").alias("file"), F.col("source_name").alias("consumer_name"), F.col("source_file").alias("consumer_file")).distinct()


def check_all(spark: SparkSession, nodes: DataFrame, edges: DataFrame, hunks: DataFrame, deleted: DataFrame, blast: int = 20, boundaries: dict | None = None, owned: DataFrame | None = None) -> DataFrame:
    """Rows 221-222: (predicate, violations, passed); owned has (file, owners)."""
    pairs = file_edges(edges, nodes)
    changed = hunks.select("file").distinct()
    parts = {
        "cycles": check_cycles(pairs, changed),
        "blast-radius": check_blast_radius(nodes, edges, hunks, blast),
        "signatures": check_signatures(nodes, hunks),
        "deleted-exports": check_deleted_exports(nodes, edges, deleted),
    }
    if boundaries:
        parts["boundaries"] = boundary_violations(pairs.join(changed.withColumnRenamed("file", "source_file"), "source_file", "left_semi"), boundaries)
    if owned is not None:
        ends = owner_boundaries(edges, nodes, owned).join(nodes.select(F.col("id").alias("source_id"), "file"), "source_id")
        parts["owner-boundaries"] = ends.join(changed, "file", "left_semi")
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("predicate"), "violations", (F.col("violations") == 0).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out

"""Scalar functions of SURVEY section 2.K and path predicates of 2.B, as JVM-side column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import LANGUAGE_OF


def literal_map(items: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in items.items() for x in pair])


def round_half_up(x: Column, digits: int) -> Column:
    """Row 240: halves go towards plus infinity."""
    return F.floor(x * 10**digits + 0.5) / F.lit(float(10**digits))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def language(path: Column) -> Column:
    """Row 105: language of a file by extension, else 'other'."""
    return F.coalesce(literal_map(LANGUAGE_OF)[extension(path)], F.lit("other"))


def language_family(path: Column) -> Column:
    """Row 245: the JavaScript dialects are one family; .h and unknown extensions have none."""
    families = {e: "javascript" if x in ("javascript", "typescript", "tsx") else x for e, x in LANGUAGE_OF.items() if e != ".h"}
    return literal_map(families)[extension(path)]


def directory(path: Column) -> Column:
    """Row 261: dirname, or '.'."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", ".").otherwise(found)


def ancestor_dirs(path: Column) -> Column:
    """Row 260: all directories above a file, the widest first, without '.'."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).otherwise(F.array().cast("array<string>"))


def directory_distance(a: Column, b: Column) -> Column:
    """Row 243: steps between two directories by way of their nearest common ancestor; '.' is the root of relative ones."""

    def chain(x: Column) -> Column:
        parts = F.split(x, "/")
        return F.when(x == ".", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))

    ca, cb = chain(a), chain(b)
    shared = F.size(F.array_intersect(ca, cb))
    return F.size(ca) + F.size(cb) - 2 * shared


def confidence(caller: Column, target: Column, imported_from: Column | None = None, workspace: Column | None = None) -> Column:
    """Row 244: how sure a call edge between two files is."""
    fa, fb = language_family(caller), language_family(target)
    steps = directory_distance(directory(caller), directory(target))
    imported = F.lit(None).cast("string") if imported_from is None else imported_from
    return (
        F.when(caller.isNull() | target.isNull() | (caller == "") | (target == ""), 0.3)
        .when(caller == target, 1.0)
        .when(imported == target, 1.0)
        .when(F.lit(False) if workspace is None else workspace, 0.95)
        .when(fa.isNotNull() & fb.isNotNull() & (fa != fb), 0.0)
        .when(steps == 0, 0.7)
        .when(steps == 1, 0.6)
        .when(steps == 2, 0.5)
        .otherwise(0.3)
    )


def is_test_path(path: Column) -> Column:
    """Row 45: exact test-file predicate."""
    low = F.lower(path)
    return (
        low.rlike(r"\.test\.|\.spec\.|__test__|__tests__|\.stories\.")
        | low.rlike(r"(^|/)(tests|test|fixtures|__fixtures__)(/|$)")
        | low.rlike(r"_test\.go$|(^|/)test_[^/]*\.py$|_test\.py$")
        | path.rlike(r"(^|/)Test[A-Z]\w*\.java$|[a-z0-9]Test\.java$")
    )


def is_test_path_like(path: Column) -> Column:
    """Row 44: the predicate of stored queries, which knows no Java names."""
    return F.lower(path).rlike(r"\.test\.|\.spec\.|__test__|__tests__|\.stories\.|(/|^)(tests|test|fixtures|__fixtures__)/|_test\.go$|(/|^)test_.*\.py$|_test\.py$")


def glob_regex(pattern: str) -> str:
    """Row 5: `**` crosses directories, `*` and `?` don't."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out += "[^/]*" if c == "*" else "[^/]" if c == "?" else c if c.isalnum() or c in "_/" else "\\" + c
            i += 1
    return f"^{out}$"


def matches_any(path: Column, patterns: list[str]) -> Column:
    """Row 371."""
    return reduce(lambda a, b: a | b, [path.rlike(glob_regex(p)) for p in patterns], F.lit(False))


def passes(path: Column, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """Row 4: in the include list, if there is one, and not in the exclude list."""
    return (matches_any(path, list(include)) if include else F.lit(True)) & ~matches_any(path, list(exclude))


def file_filter(path: Column, files: list[str]) -> Column:
    """Row 43: any of the strings occurs in the path, whatever the case."""
    return reduce(lambda a, b: a | b, [F.lower(path).contains(f.lower()) for f in files])


def glob_name(name: Column, pattern: str) -> Column:
    """Row 54: case-sensitive GLOB; a pattern without wildcards is looked for anywhere."""
    if not any(c in pattern for c in "*?["):
        return name.contains(pattern)
    regex = "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "_[]-" else "\\" + c for c in pattern)
    return name.rlike(f"(?s)^{regex}$")


def split_identifier(name: Column) -> Column:
    """Row 246: words of a camel-case or snake-case name."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, r"[_\-]+", " "), r"\s+", " "))


def estimate_tokens(text: Column) -> Column:
    """Row 248."""
    return F.ceil(F.length(text) / 4)


def epoch_date(epoch: Column) -> Column:
    """Row 249: UTC date of epoch seconds; null for zero or null."""
    return F.when(epoch != 0, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"))


def fts_tokens(query: str) -> list[str]:
    """Row 250: the words of a query without operators."""
    import re

    return [t for t in re.sub(r"[*\"():^{}~<>+\-]", " ", query).lower().split() if t not in ("and", "or", "not", "near")]


def entry_point_type(name: Column) -> Column:
    """Row 255."""
    found = F.regexp_extract(name, r"^(route|event|command):", 1)
    return F.when(found != "", found)


def symbol_relevance(name: Column, query: str, fan_in: Column) -> Column:
    """Row 48: exact 100, prefix 60, member 40, else 10; up to 25 more for callers."""
    low, q = F.lower(name), query.lower()
    bare = F.element_at(F.split(low, r"\."), -1)
    base = F.when((low == q) | (bare == q), 100).when(low.startswith(q) | bare.startswith(q), 60).when(low.contains("." + q) | low.contains(q + "."), 40).otherwise(10)
    return base + F.least(F.log2(fan_in + 1) * 5, F.lit(25.0))


def halstead(n1: Column, n2: Column, big_n1: Column, big_n2: Column) -> dict[str, Column]:
    """Row 251: from distinct and total operators and operands."""
    vocabulary, length = n1 + n2, big_n1 + big_n2
    volume = F.when(vocabulary > 0, length * F.log2(F.greatest(vocabulary, F.lit(1)))).otherwise(0.0)
    difficulty = F.when(n2 > 0, (n1 / 2) * (big_n2 / F.greatest(n2, F.lit(1)))).otherwise(0.0)
    return {"vocabulary": vocabulary, "length": length, "volume": volume, "difficulty": difficulty, "effort": difficulty * volume, "bugs": volume / 3000}


def maintainability_index(volume: Column, cyclomatic: Column, sloc: Column, comment_ratio: Column | None = None) -> Column:
    """Row 253: 0 to 100, one decimal."""
    raw = 171 - 5.2 * F.when(volume > 0, F.ln(volume)).otherwise(0.0) - 0.23 * cyclomatic - 16.2 * F.when(sloc > 0, F.ln(sloc)).otherwise(0.0)
    if comment_ratio is not None:
        raw = raw + F.when(comment_ratio > 0, 50 * F.sin(F.sqrt(2.4 * comment_ratio))).otherwise(0.0)
    return round_half_up(F.least(F.lit(100.0), F.greatest(F.lit(0.0), raw * 100 / 171)), 1)


def hotspot_density(symbols: Column, files: Column, lines: Column) -> Column:
    """Row 254: symbols a file, else symbols a line."""
    return F.when(files > 0, symbols / files).when(lines > 0, symbols / lines).otherwise(0.0)


def cosine(a: Column, b: Column) -> Column:
    """Row 242: in doubles; 0 if either vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / F.when(norm == 0, 1.0).otherwise(norm))


def risk_tier(callers: Column, has_core: Column, high: int = 10, medium: int = 3) -> Column:
    """Row 256."""
    return F.when((callers >= high) | has_core, "high").when(callers >= medium, "medium").otherwise("low")


def quality_score(coverage: Column, certainty: Column, false_positives: Column) -> Column:
    """Row 110."""
    return F.floor(coverage * 40 + certainty * 40 + (1 - false_positives) * 20 + 0.5).cast("int")

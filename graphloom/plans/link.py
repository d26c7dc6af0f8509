"""Linking facts into edges: what imports bind, barrels, calls by tiers, types, dispatch.

Every tier is an equi-join on (file, name) or on a qualified name, so a name that is defined everywhere, such as `get`,
costs no more than its calls. Only the last tiers look beyond what a file imports, and those join names and directories
after counting the definitions of each: a name with several equally near ones has no target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from ..operators.points_to import points_to
from ..operators.traverse import ancestors, resolve_barrels
from ..sources.parse import exploded
from ..storage import cut

EXTENSIONS = (".py", ".js", ".ts", ".tsx", ".jsx", ".mjs", "/__init__.py", "/index.js", "/index.ts", "")
CALLABLE = ("function", "method", "class")
TYPES = ("class", "interface", "struct", "trait", "enum", "record")
TYPE_ERASED = ("interface", "type")
SELF = ("self", "this", "cls", "super")
CONSTRUCTORS = ("__init__", "constructor", "__construct", "initialize")
NEAR = 0.5


def type_erased(kind: Column, file: Column) -> Column:
    """Row 372: an import of an interface or type of a TypeScript file is gone when the program runs."""
    return kind.isin(*TYPE_ERASED) & file.rlike(r"\.(ts|tsx|mts|cts)$")


def resolve_imports(facts: DataFrame, files: DataFrame, aliases: dict[str, str] | None = None, packages: dict[str, str] | None = None) -> DataFrame:
    """Rows 279-284: (file, source, name, alias, line, kind, resolved, module): specifiers to files. Relative and dotted
    ones, path aliases {prefix: directory}, packages {specifier: file} of the workspace and its exports, with extensions
    tried in order. module says that a Python name is itself a file, not a name in one."""
    imports = exploded(facts, "imports", sorted_joins=False)  # joined with the files only, which are fewer
    spec = F.col("source")
    for prefix, target in (aliases or {}).items():
        spec = F.when(spec.startswith(prefix), F.concat(F.lit(target), F.substring(spec, len(prefix) + 1, 10_000))).otherwise(spec)
    dots = F.length(F.regexp_extract(spec, r"^(\.+)", 1))
    python = F.col("file").endswith(".py")
    here = S.directory(F.col("file"))
    parts = F.split(here, "/")
    up = lambda n: F.when(here == ".", F.lit("")).otherwise(F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - n)), "/"))
    dotted = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    rust = F.replace(F.regexp_replace(spec, r"^(crate|self|super)::", ""), F.lit("::"), F.lit("/"))
    levels = F.size(F.filter(F.split(spec, "/"), lambda p: p == ".."))
    rest = F.regexp_replace(spec, r"^(\.\.?/)+", "")
    py_base = F.when(dots > 0, F.concat_ws("/", F.nullif(up(dots - 1), F.lit("")), F.nullif(dotted, F.lit("")))).otherwise(dotted)
    js_base = F.when(spec.startswith("."), F.concat_ws("/", F.nullif(up(levels), F.lit("")), rest)).otherwise(spec)
    rs_base = F.when(spec.startswith("crate::"), F.concat(F.lit("src/"), rust)).otherwise(F.concat_ws("/", F.nullif(up(F.lit(0)), F.lit("")), rust))
    base = F.when(python, py_base).when(F.col("file").endswith(".rs"), rs_base).otherwise(js_base)
    sub = F.when(python & F.col("name").isNotNull(), F.concat_ws("/", F.nullif(base, F.lit("")), F.col("name")))
    bare = F.regexp_replace(base, r"\.(js|jsx|mjs)$", "")
    known = F.create_map(*[F.lit(x) for kv in (packages or {"": ""}).items() for x in kv])[F.col("source")]
    # Files are fewer than imports: each is known by what is left of it without any of the extensions, so that an import
    # asks for its few paths and not for each of them with every extension. A path as it stands is of rank -1.
    endings = [*enumerate((*EXTENSIONS, ".rs", "/mod.rs")), (-1, "")]
    path = F.col("file")
    stems = [F.when(path.endswith(x), F.struct(path.substr(F.lit(1), F.length(path) - len(x)).alias("stem"), F.lit(i).alias("ending"))) for i, x in endings]
    ends = files.select(path.alias("path"), F.explode(F.array(*stems)).alias("x")).filter("x IS NOT NULL AND path <> ''").select("path", F.col("x.stem").alias("stem"), F.col("x.ending").alias("ending"))
    # A Rust path may end in a name of the file.
    rust_file = F.when(F.col("file").endswith(".rs"), F.concat(F.regexp_replace(base, r"/[^/]*$", ""), F.lit(".rs")))
    asked = ((known, 0, True), (sub, 0, False), (base, 20, False), (F.when(bare != base, bare), 40, False), (rust_file, 61, True))
    tries = [F.when(p.isNotNull(), F.struct(p.alias("stem"), F.lit(at).alias("at"), F.lit(whole).alias("whole"))) for p, at, whole in asked]
    rows = imports.withColumn("c", F.explode(F.array(*tries))).filter("c IS NOT NULL").select("*", F.col("c.stem").alias("stem"))
    hit = rows.join(ends, "stem").filter("c.whole = (ending < 0)").withColumn("rank", F.col("c.at") + F.col("ending"))
    best = hit.groupBy("file", "source", "name", "alias", "line", "kind").agg(F.min(F.struct("rank", "path")).alias("b"))
    return best.select("file", "source", "name", "alias", "line", "kind", F.col("b.path").alias("resolved"), F.col("b.rank").between(0, 19).alias("module"))


def reexport_map(resolved: DataFrame) -> DataFrame:
    """Row 285: (file, name, source_file, source_name): what a file passes on, '*' for everything. A name that a Python
    module imports can be imported from it in turn."""
    own = resolved.filter(F.col("kind").isin("reexport", "reexport-all") | (F.col("kind") == "named") & F.col("file").endswith(".py") & ~F.col("module"))
    star = F.col("kind") == "reexport-all"
    name = F.when(star, "*").otherwise(F.coalesce("alias", "name"))
    return own.filter("file <> resolved").select("file", name.alias("name"), F.col("resolved").alias("source_file"), F.when(star, "*").otherwise(F.col("name")).alias("source_name")).distinct()


def barrel_files(facts: DataFrame) -> DataFrame:
    """Row 409: (file) of those with more re-exports than definitions of their own."""
    again = F.size(F.filter("imports", lambda i: i["kind"].isin("reexport", "reexport-all")))
    return facts.filter((again > 0) & (again > F.size("defs"))).select("file")


def bound_names(resolved: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, local, original, first, target, space): what a local name stands for: the definition `original` of the file
    `target`, found through barrels from the file `first` that the import names; or, with space, all of that file."""
    module = F.col("module") | F.col("kind").isin("namespace", "module")
    last = F.element_at(F.split("source", r"[./:\\]"), -1)
    local = F.when(F.col("kind").isin("namespace", "dynamic"), F.coalesce("alias", "source")).when(F.col("kind") == "module", last).otherwise(F.coalesce("alias", "name"))
    original = F.when(F.col("kind") == "default", F.col("alias")).otherwise(F.col("name"))
    rows = resolved.filter("kind NOT IN ('side-effect', 'reexport', 'reexport-all')").select("file", local.alias("local"), original.alias("original"), F.col("resolved").alias("first"), module.alias("space"))
    rows = cut(rows.filter("local IS NOT NULL").distinct())
    definitions = nodes.filter("kind <> 'file'").select("file", "name").distinct()
    wanted = rows.filter("NOT space AND original IS NOT NULL").select(F.col("first").alias("file"), F.col("original").alias("name"))
    far = resolve_barrels(reexport_map(resolved), definitions, wanted).groupBy("file", "name").agg(F.min(F.struct("def_file", "def_name")).alias("d"))
    found = rows.join(far.select(F.col("file").alias("first"), F.col("name").alias("original"), "d"), ["first", "original"], "left")
    return found.select("file", "local", F.coalesce("d.def_name", "original").alias("original"), "first", F.coalesce("d.def_file", "first").alias("target"), "space")


def edge_rows(rows: DataFrame, kind: str | Column, confidence: Column, technique: str | Column | None = None) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    technique = technique if isinstance(technique, Column) else F.lit(technique)
    return rows.select("source_id", "target_id", kind.alias("kind"), confidence.cast("double").alias("confidence"), F.lit(0).alias("dynamic"), technique.cast("string").alias("technique"), F.lit(None).cast("string").alias("dynamic_kind")).distinct()


def import_edges(resolved: DataFrame, bound: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows 286-288: edges between files by the kind of import; through a barrel to the file behind it too, less surely;
    to the symbols that are re-exported by name; and to types that are imported by name."""
    ids = nodes.filter("kind = 'file'").select("file", "id")
    kind = F.when(F.col("kind") == "type", "imports-type").when(F.col("kind") == "dynamic", "dynamic-imports").when(F.col("kind").isin("reexport", "reexport-all") & ~F.col("file").endswith(".py"), "reexports").otherwise("imports")
    direct = resolved.select("file", F.col("resolved").alias("to"), kind.alias("edge_kind"), F.lit(1.0).alias("sure"))
    star = resolved.filter("kind = 'reexport-all'").select("file", F.col("resolved").alias("to"), F.lit("reexports-wildcard").alias("edge_kind"), F.lit(1.0).alias("sure"))
    kinds = direct.select("file", F.col("to").alias("first"), "edge_kind").filter("edge_kind <> 'reexports'").distinct()
    behind = bound.filter("first <> target").join(kinds, ["file", "first"]).select("file", F.col("target").alias("to"), "edge_kind", F.lit(0.9).alias("sure"))
    pairs = direct.unionByName(star).unionByName(behind).filter("file <> to").groupBy("file", "to", "edge_kind").agg(F.max("sure").alias("sure"))
    to_files = pairs.join(ids.withColumnRenamed("id", "source_id"), "file").join(ids.select(F.col("file").alias("to"), F.col("id").alias("target_id")), "to")
    symbols = nodes.filter("kind <> 'file'").select(F.col("file").alias("to"), F.col("name").alias("original"), F.col("id").alias("target_id"), F.col("kind").alias("t_kind"))
    named = resolved.filter("kind = 'reexport'").select("file", F.col("resolved").alias("to"), F.col("name").alias("original")).join(symbols, ["to", "original"])
    types = bound.filter("NOT space").select("file", F.col("target").alias("to"), "original").join(symbols, ["to", "original"]).filter(type_erased(F.col("t_kind"), F.col("to")))
    to_symbols = named.withColumn("edge_kind", F.lit("reexports")).unionByName(types.withColumn("edge_kind", F.lit("imports-type"))).join(ids.withColumnRenamed("id", "source_id"), "file")
    return edge_rows(to_files, F.col("edge_kind"), F.col("sure")).unionByName(edge_rows(to_symbols, F.col("edge_kind"), F.lit(1.0)))


def receiver_types(facts: DataFrame, bound: DataFrame) -> DataFrame:
    """Rows 291, 304: (file, scope, name, type, home): types of variables, declared, constructed, or returned by a function
    of the same file or an imported one, which is a little less sure; home is the file whose name the type is. Of several
    the surest, then the least."""
    types = exploded(facts, "types")
    plain = types.filter("type IS NOT NULL").select("file", "scope", "name", "type", F.lit(1.0).alias("sure"), F.col("file").alias("home"))
    returns = exploded(facts, "returns").groupBy("file", "func").agg(F.min("type").alias("type"))
    results = types.filter("source IS NOT NULL").select("file", "scope", "name", "source")
    near = results.join(returns.withColumnRenamed("func", "source"), ["file", "source"]).select("file", "scope", "name", "type", F.lit(0.9).alias("sure"), F.col("file").alias("home"))
    names = bound.filter("NOT space").select("file", F.col("local").alias("source"), F.col("target").alias("home"), F.col("original").alias("func"))
    far = results.join(names, ["file", "source"]).join(returns.withColumnRenamed("file", "home"), ["home", "func"]).select("file", "scope", "name", "type", F.lit(0.8).alias("sure"), "home")
    every = plain.unionByName(near).unionByName(far)
    best = every.groupBy("file", "scope", "name").agg(F.min(F.struct(-F.col("sure"), "type", "home")).alias("t"))
    return best.select("file", "scope", "name", F.col("t.type").alias("type"), F.col("t.home").alias("home"))


def _levels(directory: Column) -> Column:
    """The directory and the two above it, with how far up each is; the root is '.'."""
    parts = F.split(directory, "/")
    above = lambda n: F.when(directory == ".", None).when(F.size(parts) > n, F.array_join(F.slice(parts, 1, F.size(parts) - n), "/")).when(F.size(parts) == n, ".")
    each = [F.struct(directory.alias("anc"), F.lit(0).alias("up"))] + [F.struct(above(n).alias("anc"), F.lit(n).alias("up")) for n in (1, 2)]
    return F.filter(F.array(*each), lambda x: x["anc"].isNotNull())


def nearest_definitions(wanted: DataFrame, callable_: DataFrame) -> DataFrame:
    """Row 292: (file, name, target_id, t_file, t_kind): for each (file, name) the one definition of that name that is
    nearest, at most two directories away and in the same language family; none if several are as near."""
    where = wanted.select("name", S.directory(F.col("file")).alias("dir"), F.coalesce(S.language_family(F.col("file")), F.lit("")).alias("family")).distinct()
    defs = callable_.select(F.col("t_name").alias("name"), S.directory(F.col("t_file")).alias("t_dir"), F.coalesce(S.language_family(F.col("t_file")), F.lit("")).alias("family"), "target_id", "t_file", "t_kind")
    defs = defs.join(where.select("name", "family").distinct(), ["name", "family"], "left_semi")
    defs = defs.groupBy("name", "t_dir", "family").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("target_id", "t_file", "t_kind")).alias("t"))
    a = where.select("name", "dir", "family", F.explode(_levels(F.col("dir"))).alias("l")).select("name", "dir", "family", "l.anc", F.col("l.up").alias("up_a"))
    b = defs.select("name", "t_dir", "family", "n", "t", F.explode(_levels(F.col("t_dir"))).alias("l")).select("name", "t_dir", "family", "n", "t", "l.anc", F.col("l.up").alias("up_b"))
    pairs = a.join(b, ["name", "family", "anc"]).filter("up_a + up_b <= 2")
    steps = pairs.groupBy("name", "dir", "family", "t_dir").agg(F.min(F.col("up_a") + F.col("up_b")).alias("steps"), F.first("n").alias("n"), F.first("t").alias("t"))
    best = steps.withColumn("least", F.min("steps").over(W.partitionBy("name", "dir", "family"))).filter("steps = least")
    one = best.groupBy("name", "dir", "family").agg(F.sum("n").alias("n"), F.min("t").alias("t")).filter("n = 1")
    keyed = wanted.select("file", "name", S.directory(F.col("file")).alias("dir"), F.coalesce(S.language_family(F.col("file")), F.lit("")).alias("family")).distinct()
    return keyed.join(one, ["name", "dir", "family"]).select("file", "name", "t.target_id", "t.t_file", "t.t_kind")


def call_targets(facts: DataFrame, nodes: DataFrame, bound: DataFrame, hierarchy: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Rows 144, 289-294, 396-398, 402, 405: (call, file, caller, target_id, t_file, first, technique): targets of each call
    from the first tier that has any:

    0 a name of an imported module, 1 an imported name, 2 a method of the receiver's type or of the receiver itself,
    3 a definition of the same file, 4 what a name that is bound to another points to, 5 the nearest definition of the
    name, 6 a method of the own class, 7 of the nearest class above it. only are the files (file) whose calls are wanted.
    """
    wanted = facts if only is None else facts.join(only, "file", "left_semi")
    calls = cut(exploded(wanted, "calls").withColumn("call", F.monotonically_increasing_id()))
    own_self = F.coalesce(F.col("receiver").isin(*SELF), F.lit(False))
    free, concrete = F.col("receiver").isNull(), F.col("receiver").isNotNull() & ~own_self
    callable_ = cut(nodes.filter(~F.col("kind").isin("file", "directory", "parameter", "property", "interface", "type")).select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("file").alias("t_file"), F.col("kind").alias("t_kind")))
    spaces = bound.filter("space").select("file", F.col("local").alias("receiver"), F.col("target").alias("t_file"), "first")
    names = cut(bound.filter("NOT space").select("file", F.col("local").alias("name"), F.col("original").alias("t_name"), F.col("target").alias("t_file"), "first"))
    columns = ("call", "file", "caller", "target_id", "t_name", "t_file", "t_kind", "first", "technique")

    def tier(n: int, rows: DataFrame, technique: str | None = None) -> DataFrame:
        own = rows.withColumn("technique", F.lit(technique).cast("string"))
        own = own if "first" in own.columns else own.withColumn("first", F.lit(None).cast("string"))
        return own.select(*columns).withColumn("tier", F.lit(n))

    near = S.confidence(F.col("file"), F.col("t_file"), F.col("first")) >= NEAR
    in_space = calls.join(spaces, ["file", "receiver"]).join(callable_.withColumnRenamed("t_name", "name"), ["t_file", "name"]).withColumn("t_name", F.col("name"))
    imported = calls.filter(free).join(names, ["file", "name"]).join(callable_, ["t_file", "t_name"])
    same = calls.join(callable_.withColumn("name", F.col("t_name")).withColumn("file", F.col("t_file")), ["file", "name"]).filter(free | F.col("t_kind").isin(*CALLABLE))

    typed = receiver_types(facts, bound)
    of_type = lambda c: F.struct("type", "home").alias(c)
    by_scope = typed.filter("scope IS NOT NULL").select("file", F.col("scope").alias("caller"), F.col("name").alias("receiver"), of_type("here"))
    by_module = typed.filter("scope IS NULL").select("file", F.col("name").alias("receiver"), of_type("above"))
    received = calls.filter(concrete).join(by_scope, ["file", "caller", "receiver"], "left").join(by_module, ["file", "receiver"], "left")
    received = received.withColumn("of", F.coalesce("here.type", "above.type", "receiver")).withColumn("home", F.coalesce("here.home", "above.home", "file"))
    renamed = names.select(F.col("file").alias("home"), F.col("name").alias("of"), F.col("t_name").alias("real"), F.col("t_file").alias("first_type"))
    received = received.join(renamed, ["home", "of"], "left").withColumn("t_name", F.concat_ws(".", F.coalesce("real", "of"), "name"))
    by_type = received.join(callable_, "t_name").withColumn("first", F.col("first_type")).filter(near & (F.col("first_type").isNull() | (F.col("first_type") == F.col("t_file"))))

    sure = cut(tier(0, in_space).unionByName(tier(1, imported)).unionByName(tier(2, by_type)).unionByName(tier(3, same)))
    left = cut(calls.join(sure.select("call").distinct(), "call", "left_anti").filter(free | own_self))

    local = nodes.filter(F.col("kind").isin("function", "class")).select("file", "name").unionByName(names.select("file", "name")).distinct()
    stands = points_to(exploded(wanted, "bindings"), local.join(left.select("file").distinct(), "file", "left_semi")).select("file", "name", F.col("target").alias("stands"))
    alias = left.filter(free).join(stands, ["file", "name"])
    via_import = alias.join(names.withColumnRenamed("name", "stands"), ["file", "stands"]).join(callable_, ["t_file", "t_name"])
    via_file = alias.join(callable_.withColumn("stands", F.col("t_name")).withColumn("file", F.col("t_file")), ["file", "stands"])
    pointed = tier(4, via_import, "points-to").unionByName(tier(4, via_file, "points-to"))

    nearest = left.join(nearest_definitions(left, callable_.filter(F.col("t_kind").isin(*CALLABLE))), ["file", "name"]).withColumn("t_name", F.col("name"))
    own_class = F.regexp_extract(F.coalesce("caller", F.lit("")), r"^(?:.*\.)?([^.]+)\.[^.]*$", 1)
    inside = left.withColumn("owner", own_class).filter((F.col("owner") != "") & own_self)
    sibling = inside.filter("receiver <> 'super'").withColumn("t_name", F.concat_ws(".", "owner", "name")).join(callable_.filter("t_kind = 'method'"), "t_name").withColumn("first", F.lit(None).cast("string")).filter(near)
    types = nodes.filter(F.col("kind").isin(*TYPES)).select("id", "name", "file")
    up = ancestors(hierarchy, ("extends", "implements"))
    above = inside.join(types.select(F.col("id").alias("node_id"), F.col("name").alias("owner"), "file"), ["owner", "file"]).join(up, "node_id").join(types.select(F.col("id").alias("ancestor_id"), F.col("name").alias("a_name"), F.col("file").alias("t_file")), "ancestor_id")
    above = above.withColumn("t_name", F.concat_ws(".", "a_name", "name")).join(callable_, ["t_file", "t_name"])
    above = above.withColumn("nearest", F.min("depth").over(W.partitionBy("call"))).filter("depth = nearest")

    rows = sure.unionByName(pointed).unionByName(tier(5, nearest)).unionByName(tier(6, sibling)).unionByName(tier(7, above))
    rows = rows.withColumn("best", F.min("tier").over(W.partitionBy("call"))).filter("tier = best").drop("best")
    # Row 293: a call of a class also calls its constructor.
    made = rows.filter("t_kind = 'class'").select("call", "file", "caller", "t_file", "first", "technique", "tier", F.explode(F.array(*[F.concat_ws(".", "t_name", F.lit(c)) for c in CONSTRUCTORS], F.concat_ws(".", "t_name", F.element_at(F.split("t_name", r"\."), -1)))).alias("t_name"))
    return rows.unionByName(made.join(callable_, ["t_file", "t_name"]).select(rows.columns))


def call_edges(targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row 289: from the function around the call, or else the file, with the confidence of the two files."""
    sources = nodes.filter(F.col("kind").isin("function", "method", "file")).select(F.col("id").alias("source_id"), "file", F.col("name").alias("by"))
    rows = targets.withColumn("by", F.coalesce("caller", "file")).join(sources, ["file", "by"])
    sure = S.confidence(F.col("file"), F.col("t_file"), F.when(F.col("first").isNotNull(), F.col("t_file")))
    rows = rows.withColumn("sure", sure).filter("sure > 0 AND source_id <> target_id")
    best = rows.groupBy("source_id", "target_id").agg(F.max(F.struct("sure", F.coalesce("technique", F.lit("")).alias("technique"))).alias("b"))
    return edge_rows(best, "calls", F.col("b.sure"), F.nullif(F.col("b.technique"), F.lit("")))


def receiver_edges(facts: DataFrame, nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """Row 294: from a caller to the type whose method it calls on a variable, where the type is known."""
    typed = receiver_types(facts, bound).filter("scope IS NOT NULL").select("file", F.col("scope").alias("caller"), F.col("name").alias("receiver"), F.col("type").alias("local"), "home")
    calls = exploded(facts, "calls").select("file", "caller", "receiver").distinct().join(typed, ["file", "caller", "receiver"])
    names = bound.filter("NOT space").select(F.col("file").alias("home"), "local", "original", "target")
    calls = calls.join(names, ["home", "local"], "left").select("file", "caller", F.coalesce("original", "local").alias("t_name"), F.coalesce("target", "home").alias("t_file"))
    types = nodes.filter(F.col("kind").isin(*TYPES)).select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("file").alias("t_file"))
    sources = nodes.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("source_id"), "file", F.col("name").alias("caller"))
    return edge_rows(calls.join(types, ["t_name", "t_file"]).join(sources, ["file", "caller"]), "receiver", F.lit(1.0))


def hierarchy_edges(facts: DataFrame, nodes: DataFrame, bound: DataFrame) -> DataFrame:
    """Rows 295-296: the base that an import names, then one of the same file, then the nearest of that name."""
    types = nodes.filter(F.col("kind").isin(*TYPES)).select("id", "name", "file", "kind")
    rows = exploded(facts, "bases").withColumn("bare", F.element_at(F.split("base", r"[.:]+"), -1)).withColumnRenamed("kind", "edge_kind")
    rows = cut(rows.join(types.select(F.col("id").alias("source_id"), "name", "file"), ["name", "file"]))
    ends = types.select(F.col("id").alias("target_id"), F.col("name").alias("t_name"), F.col("file").alias("t_file"), F.col("kind").alias("t_kind"))
    names = bound.filter("NOT space").select("file", F.col("local").alias("bare"), F.col("original").alias("t_name"), F.col("target").alias("t_file"))
    keep = ("source_id", "base", "edge_kind", "target_id", "t_kind")
    imported = rows.join(names, ["file", "bare"]).join(ends, ["t_name", "t_file"]).select(*keep, F.lit(0).alias("tier"))
    same = rows.join(ends.withColumn("bare", F.col("t_name")).withColumn("file", F.col("t_file")), ["file", "bare"]).select(*keep, F.lit(1).alias("tier"))
    wanted = rows.select("file", F.col("bare").alias("name"))
    nearest = rows.withColumn("wanted", F.col("bare")).join(nearest_definitions(wanted, ends).withColumnRenamed("name", "wanted"), ["file", "wanted"]).select(*keep, F.lit(2).alias("tier"))
    hit = imported.unionByName(same).unionByName(nearest).withColumn("best", F.min("tier").over(W.partitionBy("source_id", "base"))).filter("tier = best AND source_id <> target_id")
    return edge_rows(hit, F.when(F.col("t_kind") == "interface", "implements").otherwise(F.col("edge_kind")), F.lit(1.0))


def implementors(edges: DataFrame, instantiated: DataFrame | None = None) -> DataFrame:
    """Rows 299, 303, 403: (base_id, sub_id) of all classes below a type, or of those that are instantiated; types without
    any are missing."""
    up = ancestors(edges, ("extends", "implements")).select(F.col("ancestor_id").alias("base_id"), F.col("node_id").alias("sub_id"))
    return up if instantiated is None else up.join(instantiated.select(F.col("id").alias("sub_id")), "sub_id", "left_semi")


def instantiated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Row 300: (id) of the classes that are called, as constructors are."""
    return edges.filter("kind = 'calls'").select(F.col("target_id").alias("id")).distinct().join(nodes.filter(F.col("kind").isin(*TYPES)).select("id"), "id", "left_semi")


def cha_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows 298, 301-302, 401: calls of a method are expanded to its overrides in instantiated subclasses, confidence 0.8.
    Constructors are not dispatched."""
    names = nodes.select("id", "name")
    pairs = implementors(edges, instantiated(edges, nodes)).join(names.select(F.col("id").alias("sub_id"), F.col("name").alias("sub")), "sub_id").join(names.select(F.col("id").alias("base_id"), F.col("name").alias("above")), "base_id")
    methods = nodes.filter("kind = 'method'").select("id", F.regexp_extract("name", r"^(.*)\.[^.]*$", 1).alias("owner"), F.element_at(F.split("name", r"\."), -1).alias("bare")).filter(~F.col("bare").isin(*CONSTRUCTORS))
    over = pairs.join(methods.select(F.col("owner").alias("above"), "bare", F.col("id").alias("target_id")), "above").join(methods.select(F.col("owner").alias("sub"), "bare", F.col("id").alias("override")), ["sub", "bare"])
    calls = edges.filter("kind = 'calls'").select("source_id", "target_id").distinct()
    fresh = calls.join(over.select("target_id", "override"), "target_id").select("source_id", F.col("override").alias("target_id")).filter("source_id <> target_id")
    return edge_rows(fresh.join(calls, ["source_id", "target_id"], "left_anti"), "calls", F.lit(0.8), "cha")


def invoked_properties(facts: DataFrame) -> DataFrame:
    """Row 395: (name) of everything that is called on a receiver."""
    return exploded(facts, "calls").filter("receiver IS NOT NULL").select("name").distinct()


def resolution_quality(found: DataFrame, expected: DataFrame) -> DataFrame:
    """One row (precision, recall) of found against expected, both (source, target)."""
    f, e = (x.select("source", "target").distinct() for x in (found, expected))
    both = f.join(e, ["source", "target"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    sizes = f.agg(F.count(F.lit(1)).alias("found")).crossJoin(e.agg(F.count(F.lit(1)).alias("expected"))).crossJoin(both)
    return sizes.select((F.col("hits") / F.col("found")).alias("precision"), (F.col("hits") / F.col("expected")).alias("recall"))

"""Declared tables (Spark DDL) and enumerations of the graph model."""

#: What a front-end says of one file. Of a name in a scope (null: the module), types has its type, or the function whose
#: result it is.
FACTS = (
    "file string, language string, error string, "
    "defs array<struct<name:string,kind:string,line:int,end_line:int,parent:string,exported:int,cognitive:int,cyclomatic:int,max_nesting:int,loc:int,sloc:int,comments:int,volume:double,mi:double,effort:double>>, "
    "imports array<struct<source:string,name:string,alias:string,line:int,kind:string>>, "
    "calls array<struct<caller:string,name:string,receiver:string,line:int>>, "
    "bases array<struct<name:string,base:string,kind:string>>, "
    "nodes array<struct<kind:string,name:string,line:int>>, "
    "blocks array<struct<func:string,idx:int,kind:string,start:int,stop:int>>, "
    "jumps array<struct<func:string,source:int,target:int,kind:string>>, "
    "flows array<struct<source:string,target:string,kind:string,param:int,expression:string,line:int>>, "
    "types array<struct<scope:string,name:string,type:string,source:string>>, "
    "returns array<struct<func:string,type:string>>, "
    "bindings array<struct<lhs:string,rhs:string>>"
)
TABLES = {
    "nodes": "id long, name string, kind string, file string, line int, end_line int, parent_id long, exported int, qualified_name string, scope string, visibility string, role string",
    "edges": "source_id long, target_id long, kind string, confidence double, dynamic int, technique string, dynamic_kind string",
    "file_hashes": "file string, hash string, mtime long, size long",
    "co_changes": "file_a string, file_b string, commit_count long, jaccard double, last_commit_epoch long",
    "file_commit_counts": "file string, commit_count long",
    "function_complexity": "node_id long, cognitive int, cyclomatic int, max_nesting int, loc int, sloc int, comment_lines int, halstead_volume double, halstead_effort double, halstead_bugs double, maintainability_index double",
    "dataflow": "source_id long, target_id long, kind string, param_index int, expression string, line int, confidence double",
    "dataflow_vertices": "id long, func_id long, kind string, name string, param_index int, line int",
    "cfg_blocks": "function_id long, block_index int, block_type string, start_line int, end_line int, label string",
    "cfg_edges": "function_id long, source_block int, target_block int, kind string",
    "ast_nodes": "file string, line int, kind string, name string, text string, parent_id long",
    "deleted_export_advisories": "file string, name string, kind string, line int, consumer_name string, consumer_file string, deleted_at long",
    "facts": FACTS,
}
CORE_KINDS = ("function", "method", "class", "interface", "type", "struct", "enum", "trait", "record", "module")
EXTENDED_KINDS = ("parameter", "property", "constant")
EDGE_KINDS = ("imports", "imports-type", "dynamic-imports", "reexports", "calls", "extends", "implements", "reexports-wildcard", "contains", "parameter_of", "receiver")
NON_COUPLING_KINDS = ("contains", "parameter_of", "receiver")
ROLES = ("entry", "core", "utility", "adapter", "leaf", "test-only", "dead", "dead-leaf", "dead-entry", "dead-ffi", "dead-unresolved")
ROLE_WEIGHTS = {
    "core": 1.0, "utility": 0.9, "entry": 0.8, "adapter": 0.5, "leaf": 0.2, "test-only": 0.1, "dead": 0.1,
    "dead-leaf": 0.0, "dead-entry": 0.3, "dead-ffi": 0.05, "dead-unresolved": 0.15,
}
LANGUAGES = {
    "javascript": ".js .jsx .mjs .cjs", "typescript": ".ts .mts .cts", "tsx": ".tsx", "hcl": ".tf .hcl", "python": ".py .pyi", "go": ".go", "rust": ".rs",
    "java": ".java", "csharp": ".cs", "ruby": ".rb .rake .gemspec", "php": ".php .phtml", "c": ".c .h", "cpp": ".cpp .cc .cxx .hpp", "kotlin": ".kt .kts",
    "swift": ".swift", "scala": ".scala", "bash": ".sh .bash", "elixir": ".ex .exs", "lua": ".lua", "dart": ".dart", "zig": ".zig", "haskell": ".hs",
    "ocaml": ".ml", "ocaml-interface": ".mli", "fsharp": ".fs .fsx", "fsharp-signature": ".fsi", "gleam": ".gleam", "clojure": ".clj .cljs .cljc",
    "julia": ".jl", "r": ".r", "erlang": ".erl .hrl", "solidity": ".sol", "objc": ".m", "cuda": ".cu .cuh", "groovy": ".groovy .gvy", "verilog": ".v .sv",
}
LANGUAGE_OF = {ext: language for language, exts in LANGUAGES.items() for ext in exts.split()}

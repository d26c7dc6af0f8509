"""Language front-ends.

One narrow pass turns (file, content) into a row of facts a file: Python by the standard library's syntax tree, with
complexity, control flow and dataflow; the other languages by lexical rules for definitions, imports and calls, as no
grammar is installed. A file that can't be parsed gives a row with its error and no facts.
"""

from __future__ import annotations

import ast
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import FACTS, LANGUAGE_OF

_KEYS = ("defs", "imports", "calls", "bases", "nodes", "blocks", "jumps", "flows", "types", "returns", "bindings")


def _lines(lines: list[str], mark: str = "#", block: bool = False) -> tuple[int, int, int]:
    """Row 252: lines, source lines, comment lines; with block, what stands between /* and */ is comment too."""
    comments, blank, inside = 0, 0, False
    for x in map(str.strip, lines):
        if not x:
            blank += 1
        elif inside or x.startswith(mark) or block and x.startswith("/*"):
            comments += 1
            inside = block and (inside or x.startswith("/*")) and "*/" not in x
    return len(lines), max(1, len(lines) - comments - blank), comments


def halstead(operators: list[str], operands: list[str]) -> tuple[float, float]:
    """Row 251: (volume, effort)."""
    n1, n2 = len(set(operators)), len(set(operands))
    volume = (len(operators) + len(operands)) * math.log2(n1 + n2) if n1 + n2 else 0.0
    return volume, (n1 / 2 * len(operands) / n2 * volume if n2 else 0.0)


#: Fields of syntax nodes in which no node stands that anything here looks at.
_PLAIN = {"ctx", "id", "attr", "arg", "name", "asname", "module", "level", "lineno", "kind", "type_comment", "conversion", "is_async", "simple"}
_fields: dict[type, tuple[str, ...]] = {}


def children(node: ast.AST) -> list[ast.AST]:
    """The nodes right below, in order, but for the contexts Load, Store and Del."""
    kind, out = type(node), []
    fields = _fields.get(kind)
    if fields is None:
        fields = _fields[kind] = () if kind is ast.Constant else tuple(f for f in node._fields if f not in _PLAIN)
    for f in fields:
        x = getattr(node, f, None)
        if type(x) is list:
            out += [y for y in x if isinstance(y, ast.AST)]
        elif isinstance(x, ast.AST):
            out.append(x)
    return out


def walked(node: ast.AST) -> list[ast.AST]:
    """The node and all below, level by level, as ast.walk has them."""
    out = [node]
    for x in out:
        out += children(x)
    return out


_BRANCH = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.comprehension, ast.match_case)
_NEST = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp, ast.Lambda)


def complexity(func: ast.AST) -> tuple[int, int, int]:
    """Rows 274-275: cognitive (1 and the nesting a branch, 1 a run of one logical operator), cyclomatic, depth."""
    cognitive, cyclomatic, deepest = 0, 1, 0

    def walk(node: ast.AST, depth: int, chained: bool = False) -> None:
        nonlocal cognitive, cyclomatic, deepest
        inner = depth
        if isinstance(node, _BRANCH):
            cyclomatic += 1
        if isinstance(node, _NEST) and not isinstance(node, ast.Lambda):
            cognitive += 1 if chained else 1 + depth
            inner = depth if chained else depth + 1
            deepest = max(deepest, inner)
        elif isinstance(node, ast.Lambda):
            inner = depth + 1
        elif isinstance(node, ast.BoolOp):
            cognitive += 1
            cyclomatic += len(node.values) - 1
        if isinstance(node, ast.If):
            walk(node.test, inner)
            for x in node.body:
                walk(x, inner)
            if len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
                walk(node.orelse[0], depth, True)
            elif node.orelse:
                cognitive += 1
                for x in node.orelse:
                    walk(x, inner)
            return
        for x in children(node):
            walk(x, inner)

    for x in children(func):
        walk(x, 0)
    return cognitive, cyclomatic, deepest


_OPERATOR = (ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.Call, ast.Assign, ast.AugAssign, ast.Return, ast.If, ast.For, ast.While, ast.Attribute, ast.Subscript)


def halstead_of(func: ast.AST, below: list[ast.AST] | None = None) -> tuple[float, float]:
    """Row 276: (volume, effort); operators are node types with an operation, operands names and constants. below are
    func's walked() nodes, where they are known."""
    operators, operands = [], []
    for x in walked(func) if below is None else below:
        if isinstance(x, _OPERATOR):
            operators.append(type(x).__name__)
        elif isinstance(x, ast.Name):
            operands.append(x.id)
        elif isinstance(x, ast.Constant):
            operands.append(repr(x.value))
    return halstead(operators, operands)


def control_flow(func: ast.FunctionDef) -> tuple[list[tuple], list[tuple]]:
    """Rows 271-272: blocks (index, kind, start, stop) and edges (source, target, kind) of a function."""
    blocks, edges = [(0, "entry", func.lineno, func.lineno), (1, "exit", None, None)], []

    def new(kind: str, start=None, stop=None) -> int:
        blocks.append((len(blocks), kind, start, stop))
        return len(blocks) - 1

    def link(sources: list[tuple[int, str]], target: int) -> None:
        edges.extend((s, target, k) for s, k in sources)

    def run(body: list[ast.stmt], open_: list[tuple[int, str]], loop) -> list[tuple[int, str]]:
        current = None
        for s in body:
            if not open_ and current is None:
                break  # unreachable
            if isinstance(s, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.Try, ast.With, ast.Match)):
                at = new({ast.If: "condition", ast.Try: "try", ast.With: "body", ast.Match: "condition"}.get(type(s), "loop_header"), s.lineno, s.lineno)
                link([(current, "fallthrough")] if current is not None else open_, at)
                current = None
                if isinstance(s, ast.If):
                    open_ = run(s.body, [(at, "branch_true")], loop) + (run(s.orelse, [(at, "branch_false")], loop) if s.orelse else [(at, "branch_false")])
                elif isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
                    breaks: list[tuple[int, str]] = []
                    link([(b, "loop_back") for b, _ in run(s.body, [(at, "branch_true")], (at, breaks))], at)
                    open_ = [(at, "loop_exit"), *breaks]
                elif isinstance(s, ast.Try):
                    open_ = run(s.body, [(at, "fallthrough")], loop)
                    for h in s.handlers:
                        open_ += run(h.body, [(at, "exception")], loop)
                    if s.finalbody:
                        open_ = run(s.finalbody, open_, loop)
                elif isinstance(s, ast.Match):
                    open_ = [x for c in s.cases for x in run(c.body, [(at, "branch_true")], loop)] + [(at, "branch_false")]
                else:
                    open_ = run(s.body, [(at, "fallthrough")], loop)
                continue
            if current is None:
                current = new("body", s.lineno, s.end_lineno)
                link(open_, current)
                open_ = []
            else:
                i, k, a, _ = blocks[current]
                blocks[current] = (i, k, a, s.end_lineno)
            if isinstance(s, (ast.Return, ast.Raise)):
                edges.append((current, 1, "return" if isinstance(s, ast.Return) else "exception"))
                return []
            if isinstance(s, (ast.Break, ast.Continue)) and loop:
                if isinstance(s, ast.Break):
                    loop[1].append((current, "break"))
                else:
                    edges.append((current, loop[0], "continue"))
                return []
        return open_ if current is None else [(current, "fallthrough")]

    link(run(func.body, [(0, "fallthrough")], None), 1)
    return blocks, edges


def _name(node: ast.AST) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        left = _name(node.value)
        return f"{left}.{node.attr}" if left else node.attr
    return None


#: What parse_python takes facts from; of other nodes, only what is below them counts.
_SEEN = {ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom, ast.Assign, ast.AnnAssign, ast.Return, ast.Call, ast.Raise, ast.Await, ast.Constant}


def parse_python(text: str) -> dict:
    tree, lines = ast.parse(text), text.split("\n")
    out: dict = {k: [] for k in _KEYS}

    def dataflow(func: ast.FunctionDef, name: str, below: list[ast.AST]) -> None:
        """Row 268: arguments flow to callees, returns to callers, assignments through attributes mutate."""
        params = [a.arg for a in func.args.args]
        for x in below:
            if isinstance(x, ast.Call) and (callee := _name(x.func)):
                for i, a in enumerate(x.args):
                    if isinstance(a, ast.Name):
                        out["flows"].append((name, callee, "flows_to", i, a.id, x.lineno))
            if isinstance(x, ast.Assign) and isinstance(x.value, ast.Call) and (callee := _name(x.value.func)):
                out["flows"].append((callee, name, "returns", None, ast.unparse(x.targets[0])[:80], x.lineno))
            if isinstance(x, (ast.Assign, ast.AugAssign)):
                for t in x.targets if isinstance(x, ast.Assign) else [x.target]:
                    if isinstance(t, (ast.Attribute, ast.Subscript)) and isinstance(t.value, ast.Name) and t.value.id in params:
                        out["flows"].append((name, name, "mutates", params.index(t.value.id), t.value.id, x.lineno))

    def visit(node: ast.AST, owner: str | None, caller: str | None) -> None:
        for x in children(node):
            if type(x) not in _SEEN:
                visit(x, owner, caller)
                continue
            scope, inside = owner, caller
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                name = f"{owner}.{x.name}" if owner else x.name
                own = lines[x.lineno - 1 : x.end_lineno]
                loc, sloc, comments = _lines(own)
                if isinstance(x, ast.ClassDef):
                    out["defs"].append((name, "class", x.lineno, x.end_lineno, owner, int(not x.name.startswith("_")), None, None, None, loc, sloc, comments, None, None, None))
                    out["bases"] += [(name, b, "extends") for b in map(_name, x.bases) if b]
                    scope, inside = name, caller
                else:
                    cognitive, cyclomatic, depth = complexity(x)
                    below = walked(x)
                    volume, effort = halstead_of(x, below)
                    out["defs"].append((name, "method" if owner else "function", x.lineno, x.end_lineno, owner, int(not x.name.startswith("_")), cognitive, cyclomatic, depth, loc, sloc, comments, volume, maintainability(volume, cyclomatic, sloc), effort))
                    blocks, jumps = control_flow(x)
                    out["blocks"] += [(name, *b) for b in blocks]
                    out["jumps"] += [(name, *e) for e in jumps]
                    dataflow(x, name, below)
                    for a in [*x.args.posonlyargs, *x.args.args, *x.args.kwonlyargs]:
                        if a.annotation and (t := _name(a.annotation)):
                            out["types"].append((name, a.arg, t, None))
                    if x.returns and (t := _name(x.returns)):
                        out["returns"].append((name, t))
                    scope, inside = None, name
            elif isinstance(x, ast.Import):
                out["imports"] += [(a.name, None, a.asname, x.lineno, "namespace") for a in x.names]
            elif isinstance(x, ast.ImportFrom):
                source = "." * x.level + (x.module or "")
                out["imports"] += [(source, None if a.name == "*" else a.name, a.asname, x.lineno, "reexport-all" if a.name == "*" else "named") for a in x.names]
            elif isinstance(x, ast.Assign) and len(x.targets) == 1 and (left := _name(x.targets[0])):
                if isinstance(x.value, ast.Call) and (callee := _name(x.value.func)):
                    made = callee.rpartition(".")[2][:1].isupper()
                    out["types"].append((caller, left, callee if made else None, None if made else callee))
                elif isinstance(x.value, ast.Name):
                    out["bindings"].append((left, x.value.id))
            elif isinstance(x, ast.AnnAssign) and (left := _name(x.target)) and (t := _name(x.annotation)):
                out["types"].append((caller, left, t, None))
            elif isinstance(x, ast.Return) and caller and isinstance(x.value, ast.Call) and (t := _name(x.value.func)) and t.rpartition(".")[2][:1].isupper():
                out["returns"].append((caller, t))
            elif isinstance(x, ast.Call):
                full = _name(x.func)
                # Row 400: getattr(thing, "name")(...) calls thing.name.
                if isinstance(x.func, ast.Call) and _name(x.func.func) == "getattr" and len(x.func.args) > 1 and isinstance(x.func.args[1], ast.Constant) and isinstance(x.func.args[1].value, str):
                    out["calls"].append((caller, x.func.args[1].value, _name(x.func.args[0]), x.lineno))
                if full:
                    receiver, _, bare = full.rpartition(".")
                    out["calls"].append((caller, bare, receiver or None, x.lineno))
                    if bare[:1].isupper():
                        out["nodes"].append(("new", full, x.lineno))
            elif isinstance(x, ast.Raise):
                out["nodes"].append(("throw", _name(x.exc.func if isinstance(x.exc, ast.Call) else x.exc) if x.exc else None, x.lineno))
            elif isinstance(x, ast.Await):
                out["nodes"].append(("await", ast.unparse(x.value)[:80], x.lineno))
            elif isinstance(x, ast.Constant) and isinstance(x.value, str) and len(x.value) > 1:
                out["nodes"].append(("string", x.value[:80], x.lineno))
            visit(x, scope, inside)

    visit(tree, None, None)
    return out


_C = r"^\s*(?:[\w:*&<>,~\[\]]+\s+)+\**(?P<name>[A-Za-z_]\w*)\s*\([^;]*\)\s*(?:const\s*)?\{"
_CLASS = r"^\s*(?:(?:export|default|public|private|protected|abstract|final|static|sealed|partial|open|data|internal|case)\s+)*(?P<kind>class|interface|struct|enum|trait|record|protocol|object|union)\s+(?P<name>[A-Za-z_]\w*)(?:[^{\n]*?(?:extends|:|<)\s*(?P<base>[A-Za-z_][\w.]*))?"
_METHOD = r"^\s+(?:(?:public|private|protected|static|final|async|override|virtual|abstract|suspend|internal)\s+)*(?:[\w<>\[\],.?]+\s+)?(?P<name>[A-Za-z_]\w*)\s*\([^;{]*\)\s*(?:throws [\w, ]+|:\s*[\w<>\[\]., |]+)?\s*\{"
_JS = [r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s+(?P<name>[A-Za-z_$][\w$]*)", r"^\s*(?:export\s+)?(?:const|let|var)\s+(?P<name>[A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::\s*[^=]+)?=>"]
#: Per language: rules of definitions and of imports.
LEXICAL = {
    **dict.fromkeys(("javascript", "typescript", "tsx"), ([*_JS, _CLASS, _METHOD], [r"(?:import|export)\b[^'\"\n]*from\s*['\"](?P<source>[^'\"]+)", r"import\s*['\"](?P<source>[^'\"]+)", r"require\(\s*['\"](?P<source>[^'\"]+)"])),
    "go": ([r"^func\s+(?:\([^)]*\)\s*)?(?P<name>\w+)\s*[(\[]", r"^type\s+(?P<name>\w+)\s+(?P<kind>struct|interface)"], [r"^\s*(?:import\s+)?(?:\w+\s+)?\"(?P<source>[\w./-]+)\"\s*$"]),
    "rust": ([r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+(?P<name>\w+)", r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?P<kind>struct|enum|trait)\s+(?P<name>\w+)"], [r"^\s*(?:pub\s+)?use\s+(?P<source>[\w:]+)"]),
    **dict.fromkeys(("java", "csharp", "groovy", "dart", "scala", "solidity"), ([_CLASS, _METHOD, r"^\s*(?:\w+\s+)*(?:def|function)\s+(?P<name>\w+)"], [r"^\s*(?:import|using)\s+(?:static\s+)?['\"]?(?P<source>[\w.:/]+)"])),
    **dict.fromkeys(("kotlin", "swift"), ([r"^\s*(?:\w+\s+)*(?:fun|func)\s+(?:[\w<>]+\.)?(?P<name>\w+)", _CLASS], [r"^\s*import\s+(?P<source>[\w.]+)"])),
    **dict.fromkeys(("c", "cpp", "objc", "cuda"), ([_C, _CLASS], [r"^\s*#\s*(?:include|import)\s*[<\"](?P<source>[^>\"]+)"])),
    "php": ([r"^\s*(?:\w+\s+)*function\s+&?(?P<name>\w+)", _CLASS], [r"^\s*use\s+(?P<source>[\w\\]+)", r"(?:require|include)(?:_once)?\s*\(?\s*['\"](?P<source>[^'\"]+)"]),
    "ruby": ([r"^\s*def\s+(?:self\.)?(?P<name>\w+[?!]?)", r"^\s*(?P<kind>class|module)\s+(?P<name>\w+)(?:\s*<\s*(?P<base>[\w:]+))?"], [r"^\s*require(?:_relative)?\s+['\"](?P<source>[^'\"]+)"]),
    "lua": ([r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)"], [r"require\s*\(?\s*['\"](?P<source>[^'\"]+)"]),
    "bash": ([r"^\s*(?:function\s+)?(?P<name>[\w-]+)\s*\(\)\s*\{"], [r"^\s*(?:source|\.)\s+(?P<source>\S+)"]),
    **dict.fromkeys(("elixir", "erlang", "gleam"), ([r"^\s*(?:pub\s+)?(?:defp?|fn)\s+(?P<name>\w+[?!]?)", r"^(?P<name>[a-z]\w*)\(.*\)\s*->", r"^\s*def(?P<kind>module)\s+(?P<name>[\w.]+)"], [r"^\s*(?:alias|import|use|-include\(\")\s*(?P<source>[\w./]+)"])),
    "zig": ([r"^\s*(?:pub\s+)?fn\s+(?P<name>\w+)"], [r"@import\(\"(?P<source>[^\"]+)"]),
    **dict.fromkeys(("haskell", "ocaml", "ocaml-interface", "fsharp", "fsharp-signature"), ([r"^(?P<name>[a-z]\w*)\s*::", r"^\s*(?:let|val)\s+(?:rec\s+)?(?P<name>[a-z]\w*)", r"^\s*(?P<kind>type|module)\s+(?P<name>\w+)"], [r"^\s*(?:import(?:\s+qualified)?|open)\s+(?P<source>[\w.]+)"])),
    "clojure": ([r"^\s*\(defn-?\s+(?P<name>[\w?!*-]+)"], [r"\[(?P<source>[\w.-]+)\s+:(?:as|refer)"]),
    "julia": ([r"^\s*function\s+(?P<name>\w+[!]?)", r"^\s*(?:mutable\s+)?(?P<kind>struct|module)\s+(?P<name>\w+)"], [r"^\s*(?:using|import)\s+(?P<source>[\w.]+)"]),
    "r": ([r"^\s*(?P<name>[\w.]+)\s*(?:<-|=)\s*function\b"], [r"(?:library|require)\(\s*['\"]?(?P<source>[\w.]+)"]),
    "verilog": ([r"^\s*(?P<kind>module)\s+(?P<name>\w+)", r"^\s*(?:function|task)\s+(?:\w+\s+)*(?P<name>\w+)"], [r"^\s*`include\s+\"(?P<source>[^\"]+)"]),
    "hcl": ([r"^\s*(?P<kind>resource|module|variable|output|data)\s+\"(?P<name>[^\"]+)\""], [r"^\s*source\s*=\s*\"(?P<source>[^\"]+)"]),
}
_WORDS = {"if", "for", "while", "switch", "catch", "return", "function", "sizeof", "elif", "else", "match", "fn", "def", "func", "fun", "defn", "super", "await", "typeof", "new"}
_KIND = {"object": "class", "protocol": "interface", "union": "struct", "resource": "module", "variable": "constant", "output": "constant", "data": "module"}


_MODULES = re.compile(r"\b(import|export)\b\s*(type\b(?!\s+from))?\s*(?:([^'\";()=]*?)\s*\bfrom\s*)?['\"]([^'\"\n]+)['\"]")
_REQUIRE = re.compile(r"(?:\b(?:const|let|var)\s+(\{[^}]*\}|[\w$]+)\s*=\s*)?(?:await\s+)?\b(require|import)\(\s*['\"]([^'\"\n]+)['\"]\s*\)")


def _specifiers(braces: str, mark: str) -> list[tuple[str, str | None, bool]]:
    """(name, alias, type only) of `a as b, type T`, or of `a: b` with another mark."""
    out = []
    for part in filter(None, (x.strip() for x in braces.strip().strip("{}").split(","))):
        typed = part.startswith("type ")
        name, _, alias = part.removeprefix("type ").partition(mark)
        out.append((name.strip(), alias.strip() or None, typed))
    return out


def module_imports(text: str) -> list[tuple]:
    """Row 286: imports, re-exports and requires of a JavaScript or TypeScript module, a row a name."""
    out = []
    for m in _MODULES.finditer(text):
        word, typed, clause, source = m[1], bool(m[2]), (m[3] or "").strip(), m[4]
        line = text.count("\n", 0, m.start()) + 1
        braces = re.search(r"\{[^}]*\}", clause)
        if word == "export":
            if clause.startswith("*"):
                out.append((source, None, None, line, "reexport-all"))
            elif braces:
                out += [(source, n, a, line, "reexport") for n, a, _ in _specifiers(braces[0], " as ")]
            continue
        if not clause:
            out.append((source, None, None, line, "side-effect"))
        if braces:
            out += [(source, n, a, line, "type" if typed or t else "named") for n, a, t in _specifiers(braces[0], " as ")]
        for part in filter(None, (x.strip() for x in re.sub(r"\{[^}]*\}", "", clause).split(","))):
            star = re.match(r"\*\s*as\s+([\w$]+)", part)
            out.append((source, None, star[1], line, "namespace") if star else (source, "default", part, line, "type" if typed else "default"))
    for m in _REQUIRE.finditer(text):
        line, kind = text.count("\n", 0, m.start()) + 1, "dynamic" if m[2] == "import" else "named"
        if m[1] and m[1].startswith("{"):
            out += [(m[3], n, a, line, kind) for n, a, _ in _specifiers(m[1], ":")]
        else:
            out.append((m[3], None, m[1], line, kind if kind == "dynamic" else "namespace" if m[1] else "side-effect"))
    return out


_TOKEN = re.compile(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|//[^\n]*|/\*.*?\*/|[A-Za-z_$][\w$]*|\d[\w.]*|&&|\|\||\?\?|[=!<>+\-*/%&|^]=+|=>|\+\+|--|<<|>>|[^\s\w]", re.S)
_BRANCHES = {"if", "for", "foreach", "while", "case", "catch", "except", "elif", "elsif", "unless", "until", "guard", "when"}
_NESTS = {"if", "for", "foreach", "while", "switch", "match", "catch", "loop", "unless", "until", "guard"}


def token_complexity(body: str) -> tuple[int, int, int, float, float]:
    """Rows 274-276 for languages with braces: cognitive, cyclomatic, greatest nesting, Halstead volume and effort.

    A branch costs one and its nesting, a run of one logical operator one, as does an else. Comments count for nothing;
    names, numbers and strings are operands, all else operators.
    """
    cognitive, cyclomatic, deepest, before, operators, operands = 0, 1, 0, "", [], []
    levels: list[bool] = []  # of the open braces: whether a nesting word opened it
    opens, round_ = False, 0
    for token in _TOKEN.findall(body):
        if token.startswith(("//", "/*")):
            continue
        if token in _BRANCHES:
            cyclomatic += 1
        if token in _NESTS:
            if token == "if" and before == "else":
                opens = True
            else:
                cognitive += 1 + sum(levels)
                opens = True
        elif token == "else":
            cognitive += 1
            opens = True
        elif token in ("&&", "||", "??"):
            cyclomatic += 1
            cognitive += token != logical if (logical := next((x for x in reversed(operators) if x in ("&&", "||", "??", ";", "{", "}")), "")) else 1
        elif token == "{":
            levels.append(opens)
            opens = False
            deepest = max(deepest, sum(levels))
        elif token == "}" and levels:
            levels.pop()
        elif token in "()":
            round_ += 1 if token == "(" else -1
        elif token == ";" and not round_:  # not those in the head of a loop
            opens = False
        (operands if token[0].isalnum() or token[0] in "_$\"'" and token not in _BRANCHES | _NESTS else operators).append(token)
        before = token
    return cognitive, cyclomatic, deepest, *halstead(operators, operands)


def maintainability(volume: float, cyclomatic: int, sloc: int) -> float:
    """Row 253, one place after the point."""
    mi = 171 - 5.2 * math.log(volume or 1) - 0.23 * cyclomatic - 16.2 * math.log(max(1, sloc))
    return math.floor(min(100.0, max(0.0, mi * 100 / 171)) * 10 + 0.5) / 10


_HASHED = ("ruby", "bash", "elixir", "r", "julia", "hcl")
_MODULAR = ("javascript", "typescript", "tsx")


def parse_lexical(text: str, language: str) -> dict:
    """Definitions, imports and calls by rules; a definition ends with its braces, or before the next one of its indent."""
    out: dict = {k: [] for k in _KEYS}
    defs, imports = LEXICAL[language]
    if language in _MODULAR:
        out["imports"], imports = module_imports(text), []
    lines, found = text.split("\n"), []
    for i, line in enumerate(lines, 1):
        for rule in defs:
            m = re.match(rule, line)
            if m and m["name"] not in _WORDS:
                kind = m.groupdict().get("kind")
                found.append((i, len(line) - len(line.lstrip()), m["name"], _KIND.get(kind, kind) or "function", m.groupdict().get("base")))
                break
        for rule in imports:
            if m := re.search(rule, line):
                out["imports"].append((m["source"], None, None, i, "module"))
                break
    stack: list[tuple[int, int, str, str]] = []  # indent, end, name, kind
    spans = []
    for n, (i, indent, name, kind, base) in enumerate(found):
        end, depth, opened = len(lines), 0, False
        for j in range(i - 1, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            opened = opened or "{" in lines[j]
            if opened and depth <= 0:
                end = j + 1
                break
            if not opened and j >= i and lines[j].strip() and len(lines[j]) - len(lines[j].lstrip()) <= indent:
                end = j if not lines[j].strip().startswith("end") else j + 1
                break
        while stack and stack[-1][1] < i:
            stack.pop()
        owner = next((s[2] for s in reversed(stack) if s[3] not in ("function", "method")), None)
        full, kind = (f"{owner}.{name}", "method") if owner and kind == "function" else (name, kind)
        loc, sloc, comments = _lines(lines[i - 1 : end], "//", True) if language not in _HASHED else _lines(lines[i - 1 : end])
        measured = (None,) * 6
        if kind in ("function", "method") and any("{" in x for x in lines[i - 1 : end]):
            body = "\n".join(lines[i - 1 : end])
            cognitive, cyclomatic, deepest, volume, effort = token_complexity(body[body.index("{") + 1 :])
            measured = (cognitive, cyclomatic, deepest, volume, maintainability(volume, cyclomatic, sloc), effort)
        public = "export" in lines[i - 1] if language in _MODULAR else "pub" in lines[i - 1] or "export" in lines[i - 1] or name[:1].isupper()
        out["defs"].append((full, kind, i, end, owner, int(public), *measured[:3], loc, sloc, comments, *measured[3:]))
        if base:
            out["bases"].append((full, base, "extends"))
        stack.append((indent, end, full, kind))
        if kind in ("function", "method"):
            spans.append((i, end, full))
    for i, line in enumerate(lines, 1):
        inner = [s for s in spans if s[0] <= i <= s[1]]
        caller = min(inner, key=lambda s: s[1] - s[0])[2] if inner else None
        if any(i == f[0] for f in found):
            line = line[line.find("{") + 1 :] if "{" in line else ""
        if m := re.search(r"([A-Za-z_$][\w$]*)\s*:?=\s*new\s+([A-Za-z_$][\w$]*)", line):
            out["types"].append((caller, m[1], m[2], None))
        elif m := re.match(r"\s*(?:const|let|var)\s+([\w$]+)\s*=\s*([A-Za-z_$][\w$]*)\s*;?\s*$", line):
            out["bindings"].append((m[1], m[2]))
        for m in re.finditer(r"([A-Za-z_$][\w$]*)\[\s*['\"]([A-Za-z_$][\w$]*)['\"]\s*\]\s*\(", line):
            out["calls"].append((caller, m[2], m[1], i))  # row 400: a literal key
        for m in re.finditer(r"(new\s+)?((?:[A-Za-z_$][\w$]*\.)*)([A-Za-z_$][\w$]*)\s*\(", line):
            if m[3] not in _WORDS:
                out["calls"].append((caller, m[3], m[2].rstrip(".") or None, i))
                if m[1]:
                    out["nodes"].append(("new", m[3], i))
    return out


def parse_file(file: str, content: bytes) -> dict:
    language = LANGUAGE_OF.get("." + file.rsplit(".", 1)[-1] if "." in file else "", None) or LANGUAGE_OF.get("." + file.rsplit(".", 1)[-1].lower(), None)
    try:
        text = bytes(content or b"").decode("utf-8")
        facts = parse_python(text) if language == "python" else parse_lexical(text, language) if language in LEXICAL else {k: [] for k in _KEYS}
        return {"file": file, "language": language, "error": None, **facts}
    except (SyntaxError, ValueError, RecursionError) as x:
        return {"file": file, "language": language, "error": f"{type(x).__name__}: {x}"[:200], **{k: [] for k in _KEYS}}


#: Files whose facts a worker holds at a time: they are many times as large as the text.
FILES_AT_ONCE = 16


def fact_frames(frames):
    """Facts of frames of (file, content), a few files at a time however large the frames are."""
    for frame in frames:
        for i in range(0, len(frame), FILES_AT_ONCE):
            part = frame.iloc[i : i + FILES_AT_ONCE]
            yield pd.DataFrame([parse_file(f, c) for f, c in zip(part["file"], part["content"])], columns=["file", "language", "error", *_KEYS])


def fact_batches(batches, target: pa.Schema):
    """The same as Arrow batches, whose tuples Arrow reads itself, as Spark would convert each field of each."""
    for frame in fact_frames(b.to_pandas() for b in batches):
        yield pa.RecordBatch.from_arrays([pa.array(frame[f.name].tolist(), type=f.type) for f in target], schema=target)


def parse(files: DataFrame) -> DataFrame:
    """Rows 6-8, 312: a row of facts a file, failures isolated to their file."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(FACTS))
    return files.select("file", "content").mapInArrow(lambda batches: fact_batches(batches, target), FACTS)


def exploded(facts: DataFrame, what: str, sorted_joins: bool = True) -> DataFrame:
    """Row 25: one of the fact lists, a row each, with its file. Spark takes their size for that of a compressed column, a
    small part of what they are, and would send millions of rows to the driver for a broadcast: they ask for joins by sorting."""
    rows = facts.select("file", F.explode(what).alias("x")).select("file", "x.*")
    return rows.hint("merge") if sorted_joins else rows

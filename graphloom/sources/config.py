"""Configuration, path aliases, workspaces and the registry of graphs."""

from __future__ import annotations

import json
import re
from pathlib import Path

DEFAULTS = {
    "include": [], "exclude": [], "query": {"depth": 3, "limit": 50},
    "co_change": {"min_support": 3, "min_jaccard": 0.3, "max_files_per_commit": 50}, "search": {"k": 60, "top_k": 15, "min_score": 0.2},
}


def merge(base: dict, over: dict) -> dict:
    """Nested objects are merged; everything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def load(repo: str | None = None, user: str | None = None) -> dict:
    """Row 20: defaults, then the user's file, then the repository's."""
    out = DEFAULTS
    for path in (user, repo):
        if path and Path(path).is_file():
            out = merge(out, json.loads(Path(path).read_text()))
    return out


def path_aliases(text: str) -> dict[str, str]:
    """Row 19: prefix -> directory of compilerOptions.paths, comments and trailing commas allowed."""
    bare = re.sub(r"(?m)(^|[\s,{\[])//.*$|/\*.*?\*/", r"\1", text)
    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", bare)).get("compilerOptions", {})
    base = options.get("baseUrl", ".").strip("./")
    clean = lambda p: "/".join(x for x in (base, p.removeprefix("./").rstrip("*")) if x)
    return {k.rstrip("*"): clean(v[0]) for k, v in options.get("paths", {}).items() if v}


def workspaces(manifests: dict[str, str]) -> dict[str, str]:
    """Rows 282, 416: package name -> its entry file, from {path of package.json: text}."""
    out = {}
    for path, text in manifests.items():
        package = json.loads(text)
        if package.get("name"):
            entry = resolve_exports(package, ".") or package.get("module") or package.get("main") or "index.js"
            out[package["name"]] = "/".join(x for x in (str(Path(path).parent).strip("."), entry.removeprefix("./")) if x)
    return out


def resolve_exports(package: dict, subpath: str, conditions: tuple[str, ...] = ("import", "require", "default")) -> str | None:
    """Row 281: the target of a subpath in package.json exports, by condition and pattern."""

    def pick(x):
        if isinstance(x, str) or x is None:
            return x
        if isinstance(x, list):
            return next((y for y in map(pick, x) if y), None)
        return next((y for c in conditions if c in x and (y := pick(x[c]))), None)

    exports = package.get("exports")
    if isinstance(exports, str) or isinstance(exports, dict) and not any(k.startswith(".") for k in exports):
        return pick(exports) if subpath == "." else None
    for key, target in (exports or {}).items():
        if key == subpath:
            return pick(target)
        head, star, tail = key.partition("*")
        if star and subpath.startswith(head) and subpath.endswith(tail) and len(subpath) >= len(head) + len(tail):
            found = pick(target)
            return found and found.replace("*", subpath[len(head) : len(subpath) - len(tail) or None])
    return None


class Registry:
    """Row 39: names of graph stores, in one JSON file."""

    def __init__(self, path: str):
        self.path = Path(path)

    def read(self) -> dict[str, str]:
        return json.loads(self.path.read_text()) if self.path.is_file() else {}

    def register(self, root: str, name: str | None = None) -> str:
        own, base = self.read(), name or Path(root).name
        name, n = base, 2
        while name in own and own[name] != root:
            name, n = f"{base}-{n}", n + 1
        self.path.write_text(json.dumps(own | {name: root}, indent=1, sort_keys=True))
        return name

    def unregister(self, name: str) -> bool:
        own = self.read()
        found = own.pop(name, None) is not None
        self.path.write_text(json.dumps(own, indent=1, sort_keys=True))
        return found

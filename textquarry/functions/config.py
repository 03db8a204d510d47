"""Project configuration that import resolution reads on the driver: commented JSON, path aliases, workspaces."""

import json
import posixpath
import re
from collections.abc import Callable


def strip_comments(text: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings are left alone."""
    out = re.sub(r"(\"(?:\\.|[^\"\\])*\")|//[^\n]*|/\*[\s\S]*?\*/", lambda m: m.group(1) or "", text)
    return re.sub(r"(\"(?:\\.|[^\"\\])*\")|,(?=\s*[}\]])", lambda m: m.group(1) or "", out)


def compiler_paths(read: Callable[[str], str | None], path: str, depth: int = 0) -> dict:
    """{"base": folder or None, "paths": {pattern: [targets]}} of a compiler configuration and those it extends; its own settings win."""
    text = read(path) if depth <= 8 else None
    if text is None:
        return {"base": None, "paths": {}}
    try:
        data = json.loads(strip_comments(text))
    except ValueError:
        return {"base": None, "paths": {}}
    here, out = posixpath.dirname(path), {"base": None, "paths": {}}
    parents = data.get("extends", [])
    for p in [parents] if isinstance(parents, str) else parents:
        at = posixpath.normpath(posixpath.join(here, p))
        got = compiler_paths(read, at if at.endswith(".json") else at + ".json", depth + 1)
        out = {"base": out["base"] or got["base"], "paths": out["paths"] or got["paths"]}
    own = data.get("compilerOptions", {})
    if "baseUrl" in own:
        out["base"] = posixpath.normpath(posixpath.join(here, own["baseUrl"]))
    if "paths" in own:
        base = out["base"] if out["base"] is not None else here
        out["paths"] = {k: [posixpath.normpath(posixpath.join(base, t)) for t in ([v] if isinstance(v, str) else v)] for k, v in own["paths"].items()}
    return out


def aliased(module: str, config: dict) -> list[str]:
    """The paths a bare import may mean under a configuration: exact patterns first, then the one with the longest prefix before ``*``."""
    best: tuple[int, list[str]] = (-1, [])
    for pattern, targets in config["paths"].items():
        head, star, tail = pattern.partition("*")
        if not star and pattern == module:
            return targets
        if star and module.startswith(head) and module.endswith(tail) and len(head) > best[0]:
            middle = module[len(head) : len(module) - len(tail)]
            best = (len(head), [t.replace("*", middle) for t in targets])
    return best[1] or ([posixpath.join(config["base"], module)] if config["base"] is not None else [])


def workspace_regex(glob: str) -> str:
    """``a/*`` and ``a/**`` over directories."""
    return "^" + re.escape(glob.removeprefix("./").rstrip("/")).replace(r"\*\*", ".+").replace(r"\*", "[^/]+") + "$"


def path_arguments(paths: list[str], exists: Callable[[str], bool]) -> tuple[list[str], list[str]]:
    """(paths, globs): an argument with ``*``, ``?`` or ``[`` that names nothing is a glob."""
    globs = [p for p in paths if any(c in p for c in "*?[") and not exists(p)]
    return [p for p in paths if p not in globs], globs


def script_aliases(read: Callable[[str], str | None], paths: list[str]) -> list[tuple]:
    """(folder, head, tail, target, star) of the path patterns and base folders of the compiler configurations at ``paths``."""
    out = []
    for path in paths:
        here, config = posixpath.dirname(path), compiler_paths(read, path)
        for pattern, targets in config["paths"].items():
            head, star, tail = pattern.partition("*")
            out += [(here, head, tail, t, bool(star)) for t in targets]
        if config["base"] is not None:
            out.append((here, "", "", posixpath.normpath(posixpath.join(config["base"], "*")), True))
    return out


def workspace_packages(read: Callable[[str], str | None], paths: list[str]) -> list[tuple[str, str]]:
    """(name, entry or folder) of the packages whose manifests stand at ``paths``."""
    out = []
    for path in paths:
        try:
            data = json.loads(read(path) or "")
        except ValueError:
            continue
        if isinstance(data, dict) and isinstance(data.get("name"), str):
            here, main = posixpath.dirname(path), data.get("main")
            out.append((data["name"], posixpath.normpath(posixpath.join(here, main)) if isinstance(main, str) else here))
    return out


def crate_roots(read: Callable[[str], str | None], paths: list[str]) -> list[tuple[str, str]]:
    """(crate name, source folder) of the manifests at ``paths``; a name's hyphens are underscores in code."""
    out = []
    for path in paths:
        m = re.search(r"^\[package\][^\[]*?^name\s*=\s*\"([^\"]+)\"", read(path) or "", re.M | re.S)
        if m:
            out.append((m.group(1).replace("-", "_"), posixpath.join(posixpath.dirname(path), "src")))
    return out

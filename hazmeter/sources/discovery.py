"""Which folders a run walks and what they are called: packages of Go, Python, npm and Cargo workspaces.

Manifests are small and few, so all of this is driver code; only the files found go to the executors.
"""

from __future__ import annotations

import glob
import json
import os
import re
import tomllib
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from hazmeter.model import ResolveError
from hazmeter.operators.filters import glob_regex, normalise_glob
from hazmeter.sources.functions import MANIFEST, SKIPPED


@dataclass(frozen=True)
class Package:
    name: str
    root: str
    features: dict[str, list[str]] = field(default_factory=dict, compare=False)


@dataclass(frozen=True)
class Target:
    root: str
    crate_name: str | None = None
    join_key: str | None = None
    skip: tuple[str, ...] = ()
    features: tuple[str, ...] = ()


def _read(path: str) -> str:
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError) as err:
        raise ResolveError(f"{path}: {err}") from err


def _folders(path: str) -> list[str]:
    return sorted(e.name for e in os.scandir(path) if e.is_dir(follow_symlinks=False)) if os.path.isdir(path) else []


def matching_dirs(root: str, patterns: Iterable[str], is_package: Callable[[str], bool], is_skipped: Callable[[str], bool]) -> list[str]:
    """Package folders that an include pattern reaches and no ``!`` pattern does, each once, in path order.

    Wildcards pass over skipped folders; a literal segment is taken as it is written.
    """
    cleaned = [normalise_glob(p) for p in patterns]
    out: set[str] = set()

    def reach(folder: str, segments: list[str]) -> None:
        if not segments:
            if is_package(folder):
                out.add(folder)
            return
        first, rest = segments[0], segments[1:]
        if first == "**":
            reach(folder, rest)
        if first in ("*", "**"):
            for name in _folders(folder):
                if not is_skipped(name):
                    reach(os.path.join(folder, name), segments if first == "**" else rest)
        elif os.path.isdir(os.path.join(folder, first)):
            reach(os.path.join(folder, first), rest)

    for p in cleaned:
        if p and not p.startswith("!"):
            reach(root, p.split("/"))
    gone = [re.compile(glob_regex(p[1:])) for p in cleaned if p.startswith("!") and p[1:]]
    kept = [d for d in out if not any(g.search(os.path.relpath(d, root).replace(os.sep, "/")) for g in gone)]
    return sorted(kept, key=lambda d: d.split(os.sep))


def unique(packages: list[Package]) -> list[Package]:
    twice = sorted(n for n, k in Counter(p.name for p in packages).items() if k > 1)
    if twice:
        raise ResolveError(f"duplicate package name `{twice[0]}`")
    return packages


def select(packages: list[Package], names: Iterable[str]) -> list[Package]:
    """The named packages in the order asked for, repeats included."""
    by_name = {p.name: p for p in packages}
    for n in names:
        if n not in by_name:
            raise ResolveError(f"unknown package `{n}`")
    return [by_name[n] for n in names]


def nested_roots(package: Package, selected: list[Package]) -> tuple[str, ...]:
    """Roots of other selected packages below this one."""
    inside = package.root.rstrip("/") + "/"
    return tuple(p.root for p in selected if p.root != package.root and p.root.startswith(inside))


def join_key(root: str, base: str) -> str:
    """Path of a package below the run's path; at the path itself the folder's name, or ``.``."""
    rel = os.path.relpath(os.path.realpath(root), os.path.realpath(base)).replace(os.sep, "/")
    return rel if rel != "." else os.path.basename(os.path.realpath(root)) or "."


# Go


def module_name(text: str) -> str | None:
    return next((w[6:].strip() for w in map(str.strip, text.splitlines()) if w.startswith("module") and w[6:].strip()), None)


def go_modules(root: str) -> list[Package]:
    """Each go.mod at or below ``root``, by module path."""
    out = []

    def visit(folder: str) -> None:
        manifest = os.path.join(folder, "go.mod")
        if os.path.isfile(manifest):
            name = module_name(_read(manifest))
            if not name:
                raise ResolveError(f"{manifest}: no module line")
            out.append(Package(name, folder))
        for name in _folders(folder):
            if name not in SKIPPED["go"]:
                visit(os.path.join(folder, name))

    visit(root)
    return sorted(out, key=lambda p: p.name)


def modules_for_remap(root: str) -> list[Package]:
    """Modules below ``root``, or else the module that encloses it."""
    found, folder = go_modules(root), os.path.realpath(root)
    while not found and os.path.dirname(folder) != folder:
        folder = os.path.dirname(folder)
        manifest = os.path.join(folder, "go.mod")
        if os.path.isfile(manifest) and (name := module_name(_read(manifest))):
            found = [Package(name, folder)]
    return found


def go_packages(root: str) -> list[Package]:
    """Folders with a source that is no test, named by import path; a nested module's folders are its own."""
    out = []
    for module in go_modules(root):

        def visit(folder: str, name: str) -> None:
            if any(e.is_file() and e.name.endswith(".go") and not e.name.endswith("_test.go") for e in os.scandir(folder)):
                out.append(Package(name, folder))
            for child in _folders(folder):
                below = os.path.join(folder, child)
                if child not in SKIPPED["go"] and not os.path.isfile(os.path.join(below, "go.mod")):
                    visit(below, f"{name}/{child}")

        visit(module.root, module.name)
    return unique(sorted(out, key=lambda p: p.name))


# Python


def _py_skipped(name: str) -> bool:
    return name in SKIPPED["python"] or name.endswith(".egg-info")


def _py_package(folder: str) -> tuple[Package, list[str]]:
    try:
        doc = tomllib.loads(_read(os.path.join(folder, "pyproject.toml")))
    except tomllib.TOMLDecodeError as err:
        raise ResolveError(f"{folder}/pyproject.toml: {err}") from err
    tool = doc.get("tool", {})
    name = doc.get("project", {}).get("name") or tool.get("poetry", {}).get("name") or os.path.basename(os.path.realpath(folder))
    return Package(name, folder), tool.get("uv", {}).get("workspace", {}).get("members", [])


def is_python_project(folder: str) -> bool:
    return os.path.isfile(os.path.join(folder, "pyproject.toml"))


def python_packages(root: str) -> list[Package]:
    """The root's package, then the members its uv workspace names; without such a list, nested projects.

    A root without a manifest is refused.
    """
    own, members = _py_package(root)
    dirs = matching_dirs(root, members or ["**"], is_python_project, _py_skipped)
    found = [_py_package(d)[0] for d in dirs if os.path.realpath(d) != os.path.realpath(root)]
    if members and not found:
        raise ResolveError(f"{root}: workspace members match no package")
    return unique(sorted([own, *found], key=lambda p: p.name))


# npm


def strip_jsonc(text: str) -> str:
    """JSON without comments and trailing commas; strings stay as they are."""
    text = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*[\s\S]*?\*/', lambda m: m[1] or " ", text)
    return re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[]}])', lambda m: m[1] or "", text)


def _no_twice(pairs: list[tuple[str, object]]) -> dict:
    if [k for k, _ in pairs].count("name") > 1:
        raise ValueError("duplicate field `name`")
    return dict(pairs)


def is_npm_package(folder: str) -> bool:
    return os.path.isfile(os.path.join(folder, "package.json"))


def pnpm_patterns(text: str) -> list[str]:
    """Items of the ``packages:`` list of a pnpm workspace file."""
    out, inside = [], False
    for raw in text.splitlines():
        line = re.sub(r"""((?:"[^"]*"|'[^']*'|[^#"'])*)(?:(?<=\s)#|^#).*""", r"\1", raw).strip()
        if not line:
            continue
        if not inside:
            inside = line == "packages:"
        elif m := re.fullmatch(r"-\s+(\"[^\"]*\"|'[^']*'|\S.*)", line):
            out.append(m[1].strip("\"'"))
        elif re.match(r"[A-Za-z_][\w-]*\s*:", line):
            break
        else:
            raise ResolveError("missing or invalid packages list")
    if not inside:
        raise ResolveError("missing or invalid packages list")
    return out


def _npm_package(folder: str) -> tuple[Package, list[str] | None]:
    path = os.path.join(folder, "package.json")
    try:
        doc = json.loads(strip_jsonc(_read(path)), object_pairs_hook=_no_twice)
    except ValueError as err:
        raise ResolveError(f"{path}: {err}") from err
    spaces = doc.get("workspaces")
    spaces = spaces.get("packages", []) if isinstance(spaces, dict) else spaces
    return Package(doc.get("name") or os.path.basename(os.path.realpath(folder)), folder), spaces


def npm_packages(root: str) -> list[Package]:
    """Members of the workspace at ``root`` (its manifest's list, else pnpm's file), or the one package there."""
    own, patterns = _npm_package(root)
    pnpm = os.path.join(root, "pnpm-workspace.yaml")
    if patterns is None and os.path.isfile(pnpm):
        patterns = pnpm_patterns(_read(pnpm))
    if not patterns:
        return [own]
    dirs = matching_dirs(root, patterns, is_npm_package, lambda n: n == "node_modules")
    if not dirs:
        raise ResolveError(f"{root}: workspace patterns match no package")
    return unique(sorted((_npm_package(d)[0] for d in dirs), key=lambda p: p.name))


# Cargo


def cargo_packages(metadata: str) -> list[Package]:
    """Workspace members of ``cargo metadata --no-deps`` output; each member must have its package."""
    doc = json.loads(metadata)
    by_id = {p["id"]: p for p in doc.get("packages", [])}
    out = []
    for member in doc.get("workspace_members", []):
        if member not in by_id:
            raise ResolveError(f"workspace member `{member}` has no package")
        p = by_id[member]
        out.append(Package(p["name"], os.path.dirname(p["manifest_path"]), p.get("features", {})))
    return unique(out)


def _manifest(folder: str) -> dict:
    try:
        return tomllib.loads(_read(os.path.join(folder, "Cargo.toml")))
    except tomllib.TOMLDecodeError as err:
        raise ResolveError(f"{folder}/Cargo.toml: {err}") from err


def _dependencies(doc: dict) -> list[tuple[str, dict]]:
    tables = [doc, *doc.get("target", {}).values()]
    return [(name, d) for t in tables for kind in ("dependencies", "dev-dependencies", "build-dependencies") for name, d in t.get(kind, {}).items() if isinstance(d, dict)]


def _cargo_package(folder: str, doc: dict) -> Package:
    """The package with its features; an optional dependency is one too unless a feature names it with ``dep:``."""
    features = {k: list(v) for k, v in doc.get("features", {}).items()}
    named = {x for v in features.values() for x in v if x.startswith("dep:")}
    for name, d in _dependencies(doc):
        if d.get("optional") and f"dep:{name}" not in named:
            features.setdefault(name, [f"dep:{name}"])
    return Package(doc["package"]["name"], folder, features)


def cargo_workspace(path: str) -> tuple[str, list[Package]]:
    """Root and members of the workspace around ``path``, read from the manifests; no toolchain is asked.

    Members are those listed and the path dependencies below the root. A package in no workspace is its own.
    """
    path = os.path.realpath(path)
    own, root = _manifest(path), path
    while "workspace" not in (doc := _manifest(root) if os.path.isfile(os.path.join(root, "Cargo.toml")) else {}):
        if os.path.dirname(root) == root:
            root, doc = path, own
            break
        root = os.path.dirname(root)
    space = doc.get("workspace", {})
    has_manifest = lambda d: os.path.isfile(os.path.join(d, "Cargo.toml"))
    gone = {os.path.realpath(os.path.join(root, e)) for e in space.get("exclude", [])}
    todo = [root] if "package" in doc else []
    for pattern in space.get("members", []):
        hits = glob.glob(os.path.join(root, pattern))
        if not hits:
            raise ResolveError(f"{root}: workspace member `{pattern}` matches nothing")
        todo += filter(has_manifest, hits)
    docs: dict[str, dict] = {}
    while todo:
        folder = os.path.realpath(todo.pop())
        if folder in docs or folder in gone or not folder.startswith(root):
            continue
        docs[folder] = _manifest(folder)
        todo += [f for _, d in _dependencies(docs[folder]) if "path" in d and has_manifest(f := os.path.join(folder, d["path"]))]
    if path not in docs and path != root:
        root, docs = path, {path: own}
    return root, unique([_cargo_package(f, docs[f]) for f in sorted(docs, key=lambda f: f.split(os.sep)) if "package" in docs[f]])


def cargo_root(path: str, metadata: str | None = None) -> tuple[str, list[Package]]:
    """Root and members: what ``cargo metadata`` printed, where that is given, or what the manifests say."""
    if metadata is None:
        return cargo_workspace(path)
    return os.path.realpath(json.loads(metadata).get("workspace_root", path)), cargo_packages(metadata)


def cargo_targets_at(path: str, metadata: str | None = None) -> list[Package]:
    """All members at the root of a workspace, one at a member's own folder."""
    root, packages = cargo_root(path, metadata)
    if os.path.realpath(path) == root:
        return packages
    here = [p for p in packages if p.root == os.path.realpath(path)]
    if not here:
        raise ResolveError(f"{path} is neither the root of a workspace nor of a package")
    return here


def feature_seeds(package: Package | None, features: Iterable[str] = (), all_features: bool = False, default: bool = True) -> list[str]:
    """What switches features on before the closure."""
    if package is None:
        return sorted(set(features))
    if all_features:
        return sorted(k for k in package.features if k != "default")
    return [*(package.features.get("default", []) if default else []), *features]


def enabled_features(package: Package | None, features: Iterable[str] = (), all_features: bool = False, default: bool = True) -> list[str]:
    """The closure over a manifest's features, sorted; dependencies and ``crate/feature`` entries are none."""
    todo, seen = feature_seeds(package, features, all_features, default), set()
    if package is None:
        return todo
    while todo:
        f = todo.pop()
        if f not in seen and not f.startswith("dep:") and "/" not in f:
            seen.add(f)
            todo += package.features.get(f, [])
    return sorted(seen)


PACKAGES = {"go": go_packages, "python": python_packages, "typescript": npm_packages, "rust": lambda path, metadata=None: cargo_root(path, metadata)[1]}


@dataclass(frozen=True)
class FeatureFlags:
    """Which Cargo features a run takes as enabled."""

    features: tuple[str, ...] = ()
    all_features: bool = False
    default: bool = True

    def of(self, package: Package | None) -> tuple[str, ...]:
        return tuple(enabled_features(package, self.features, self.all_features, self.default))


def targets(path: str, language: str, workspace: bool = False, names: Iterable[str] = (), flags: FeatureFlags = FeatureFlags(), metadata: str | None = None) -> list[Target]:
    """What to walk: the selected packages, else what the manifest at ``path`` stands for, else the bare path.

    At a Go module or a Cargo workspace that is every package of it, at a Python or npm project that one alone.
    ``metadata``: the output of ``cargo metadata``, in place of reading Cargo's manifests.
    """
    names = list(names)
    if language not in (*PACKAGES, "rust"):
        if workspace or names:
            raise ResolveError(f"{language} has no packages")
        return [Target(path)]
    manifest = os.path.isfile(os.path.join(path, MANIFEST[language]))
    if not (workspace or names or manifest):
        return [Target(path, features=flags.of(None) if language == "rust" else ())]
    if language == "rust" and not workspace and not names:
        chosen = cargo_targets_at(path, metadata)
    elif language != "go" and not workspace and not names:
        chosen = [(_py_package if language == "python" else _npm_package)(path)[0]]
    else:
        found = PACKAGES[language](path, metadata) if language == "rust" else PACKAGES[language](path)
        if not found:
            raise ResolveError(f"{path}: no {language} package")
        chosen = select(found, names) if names else found
    keyed = language in ("python", "typescript")
    return [Target(p.root, p.name, join_key(p.root, path) if keyed else None, nested_roots(p, chosen), flags.of(p) if language == "rust" else ()) for p in chosen]

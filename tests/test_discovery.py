import json
import os

import pytest

from hazmeter.model import ResolveError
from hazmeter.sources import discovery as d
from hazmeter.sources.functions import walk


def tree(root, files):
    for name, text in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return str(root)


def test_go(tmp_path):
    root = tree(tmp_path, {"go.mod": "// x\nmodule example.com/a\n", "m.go": "package a\n", "pkg/p.go": "", "pkg/p_test.go": "", "vendor/v.go": "", "docs/x.txt": "", "sub/go.mod": "module example.com/b\n", "sub/s.go": ""})
    assert [p.name for p in d.go_packages(root)] == ["example.com/a", "example.com/a/pkg", "example.com/b"]
    found = d.targets(root, "go")
    assert [t.crate_name for t in found] == ["example.com/a", "example.com/a/pkg", "example.com/b"]
    assert [os.path.relpath(f, root) for f in walk(found[0].root, "go", found[0].skip)] == ["m.go"]
    one = d.targets(root, "go", names=["example.com/a"])[0]
    assert [os.path.relpath(f, root) for f in walk(one.root, "go", one.skip)] == ["m.go", "pkg/p.go"]
    with pytest.raises(ResolveError, match="unknown package `x`"):
        d.targets(root, "go", names=["x"])
    assert [m.name for m in d.modules_for_remap(str(tmp_path / "docs"))] == ["example.com/a"]


def test_python(tmp_path):
    root = tree(tmp_path, {"pyproject.toml": '[project]\nname = "top"\n[tool.uv.workspace]\nmembers = ["libs/*", "!libs/old"]\n', "t.py": "", "libs/a/pyproject.toml": '[tool.poetry]\nname = "pa"\n', "libs/a/a.py": "", "libs/old/pyproject.toml": "", ".venv/x.py": ""})
    assert [p.name for p in d.python_packages(root)] == ["pa", "top"]
    alone = d.targets(root, "python")
    assert [t.crate_name for t in alone] == ["top"] and [os.path.basename(f) for f in walk(root, "python")] == ["t.py"]
    assert [(t.crate_name, t.join_key) for t in d.targets(root, "python", workspace=True)] == [("pa", "libs/a"), ("top", os.path.basename(root))]
    assert d.targets(str(tmp_path / "libs"), "python") == [d.Target(str(tmp_path / "libs"))]


def test_npm(tmp_path):
    root = tree(tmp_path, {"package.json": '{"name": "top", /* c */ "workspaces": {"packages": ["p/**",]},} // e', "p/a/package.json": '{"name": "@s/a"}', "p/b/package.json": "{}", "p/node_modules/z/package.json": "{}"})
    assert [p.name for p in d.npm_packages(root)] == ["@s/a", "b"]
    assert d.pnpm_patterns("x: 1\npackages:\n  - 'a/*' # c\n  - \"!b\"\n  - c\nother: 2\n") == ["a/*", "!b", "c"]
    for bad in ("", "packages:\n  nothing\n", "packages: [a]\n"):
        with pytest.raises(ResolveError):
            d.pnpm_patterns(bad)
    (tmp_path / "p/b/package.json").write_text('{"name": "@s/a"}')
    with pytest.raises(ResolveError, match="duplicate"):
        d.npm_packages(root)
    (tmp_path / "package.json").write_text('{"name": "a", "name": "b"}')
    with pytest.raises(ResolveError):
        d.npm_packages(root)


def test_cargo():
    meta = {"packages": [{"id": "1", "name": "a", "manifest_path": "/w/a/Cargo.toml", "features": {"default": ["x"], "x": ["y", "dep:z", "q/r"], "y": ["x"], "w": []}}], "workspace_members": ["1"]}
    a = d.cargo_packages(json.dumps(meta))[0]
    assert a == d.Package("a", "/w/a") and d.enabled_features(a) == ["x", "y"]
    assert d.enabled_features(a, ["w"], default=False) == ["w"] and d.enabled_features(a, all_features=True) == ["w", "x", "y"]
    assert d.enabled_features(None, ["b", "a", "b"]) == ["a", "b"]
    with pytest.raises(ResolveError):
        d.cargo_packages(json.dumps(meta | {"workspace_members": ["2"]}))


def test_nested_and_keys(tmp_path):
    ps = [d.Package("a", "/w"), d.Package("b", "/w/b"), d.Package("c", "/wx")]
    assert d.nested_roots(ps[0], ps) == ("/w/b",) and d.nested_roots(ps[2], ps) == ()
    assert d.join_key(str(tmp_path / "x" / "y"), str(tmp_path)) == "x/y"


def test_cargo_manifests(tmp_path):
    root = tree(
        tmp_path,
        {
            "Cargo.toml": '[workspace]\nmembers = ["crates/*"]\nexclude = ["crates/old"]\n',
            "crates/a/Cargo.toml": '[package]\nname = "a"\n[features]\ndefault = ["x"]\nx = ["dep:opt"]\n[dependencies]\nopt = { version = "1", optional = true }\nsoft = { version = "1", optional = true }\nb = { path = "../../more/b" }\n',
            "crates/a/src/lib.rs": "", "crates/a/src/tests.rs": "", "crates/a/src/mytests.rs": "", "crates/a/src/x_tests.rs": "", "crates/a/tests/t.rs": "", "crates/a/src/tests/in.rs": "", "crates/a/target/t.rs": "",
            "crates/old/Cargo.toml": '[package]\nname = "old"\n', "more/b/Cargo.toml": '[package]\nname = "b"\n', "more/b/b.rs": "",
        },
    )
    found = d.targets(root, "rust")
    assert [(t.crate_name, t.features, t.join_key) for t in found] == [("a", ("x",), None), ("b", (), None)]
    assert [os.path.relpath(f, found[0].root) for f in walk(found[0].root, "rust")] == ["src/lib.rs", "src/mytests.rs", "src/tests/in.rs"]
    flags = d.FeatureFlags(("y",), default=False)
    assert [t.features for t in d.targets(root + "/crates/a", "rust", flags=flags)] == [("y",)]
    assert d.FeatureFlags(all_features=True).of(d.cargo_workspace(root)[1][0]) == ("soft", "x")
    assert [t.crate_name for t in d.targets(root, "rust", names=["b"])] == ["b"]
    assert d.targets(root + "/more", "rust", flags=flags) == [d.Target(root + "/more", features=("y",))]
    with pytest.raises(ResolveError):
        d.targets(root, "rust", names=["old"])

"""Each case of the queries by itself, and rules of the scanners on sources written for them."""

import re

import pytest

from hazmeter.operators.filters import constraint_holds, glob_regex, skip_go_file
from hazmeter.plans.cases import SCANS, TAGGED
from hazmeter.sources import scan_go, scan_python, scan_typescript
from hazmeter.sources.functions import SCANNERS


@pytest.mark.parametrize("case", SCANS, ids=lambda c: f"{c.language} {c.name}")
def test_case(case):
    for at, metric in ((3, "cyclomatic"), (4, "cognitive")):
        run = lambda: SCANNERS[case.language](case.content.decode(), metric, *([case.features] if case.language == "rust" else []))  # noqa: B023, E731
        if case.error:
            with pytest.raises((ValueError, UnicodeDecodeError), match=re.escape(case.error)):
                run()
        elif not (case.language == "go" and skip_go_file(case.content.decode())):
            assert [tuple(f) for f in run()] == [(f[0], f[1], f[2], f[at]) for f in case.functions]


@pytest.mark.parametrize("name,text,bare,fancy", TAGGED)
def test_build_tags(name, text, bare, fancy):
    assert (not skip_go_file(text), not skip_go_file(text, ["fancy"])) == (bare, fancy)


def test_constraint_values():
    assert constraint_holds("a && (b || !c)", ["a", "b", "c"]) and not constraint_holds("a && (b || !c)", ["a", "c"])
    assert constraint_holds("windows", goos="windows") and not constraint_holds("unix", goos="windows")
    for broken in ("", "&&", "!", "()", "(a"):
        assert not constraint_holds(broken, ["a"])


def test_python_places():
    src = "@mark\nclass Shop:\n    @mark\n    async def open(self): return 1\n\n    class Till:\n        def pay(self):\n            def coin():\n                yield\n            return coin\n# end\n"
    assert [tuple(f) for f in scan_python.analyse(src)] == [("Shop.open", 4, 4, 1), ("Till.pay", 7, 10, 1), ("Till.coin", 8, 9, 1)]
    assert scan_python.analyse("") == [] == scan_python.analyse("x = 'def f(): pass'\n")


def test_go_places():
    src = "package shop\n\nfunc (s *Shop) Open(at int) (ok bool, err error) {\n\treturn\n}\n\nvar f = func() {}\n\nfunc List() []string { return nil }\n\nfunc Chan() <-chan int\n"
    assert [tuple(f) for f in scan_go.analyse(src)] == [("Shop.Open", 3, 5, 1), ("List", 9, 9, 1)]


def test_typescript_open_blocks():
    # an interpolation that does not close is text of its template
    assert [f[0] for f in scan_typescript.analyse("const t = `${ a`;\nfunction after() { }\n")] == ["after"]
    for broken in ("`open", "x = <p q={`}", "/* a"):
        with pytest.raises(ValueError):
            scan_typescript.analyse(broken)


@pytest.mark.parametrize(
    "pattern,inside,outside",
    [("libs/*", ["libs/a"], ["libs", "libs/a/b", "xlibs/a"]), ("libs/**", ["libs", "libs/a", "libs/a/b"], ["lib"]), ("**/app", ["app", "x/app", "x/y/app"], ["xapp", "app/x"]), ("**", ["a", "a/b"], []), ("a/**/z", ["a/z", "a/b/z", "a/b/c/z"], ["a/b", "z"]), ("v1.0", ["v1.0"], ["v1x0"])],
)
def test_globs(pattern, inside, outside):
    found = re.compile(glob_regex(pattern)).search
    assert all(map(found, inside)) and not any(map(found, outside))

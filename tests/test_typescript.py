import pytest

from hazmeter.sources import scan_typescript as ts

CASES = [
    ("function f(x: number) { if (x > 0 && x < 9 || x ?? 0) { return x ? 1 : 2; } }", [("f", 6)]),
    ("export default async function g<T>(a: T): Promise<T> { while (a) { do { } while (a) } }", [("g", 4)]),
    ("const a = (x: number): number => { for (;;) {} };\nlet b = function () { try {} catch (e) {} };\nvar c = x => { return x?.y; };\nconst d = () => 1;", [("a", 2), ("b", 2), ("c", 1)]),
    ("class C extends B<T> implements I { constructor(private x: number) {} static async m(): Promise<void> { if (1) {} } get v(): number { return 1 } set v(n) { } [Symbol.iterator]() { } @dec() q() { } }", [("C.constructor", 1), ("C.m", 2), ("C.get v", 1), ("C.set v", 1), ("C.[Symbol.iterator]", 1), ("C.q", 1)]),
    ("function outer() {\n function inner() {\n if (a) {}\n }\n if (b) {}\n}", [("outer", 2), ("inner", 2)]),
    ("function s() { const t = `if ${a ? `for` : '}'} {`; const r = /if[/]&&/g; // if\n /* && */ return <a b=\"if\" c={d && e}>x</a>; }", [("s", 1)]),
    ("function sw(x) { switch (x) { case 1: case 2: default: } }", [("sw", 3)]),
]


@pytest.mark.parametrize("src,want", CASES)
def test_cyclomatic(src, want):
    assert [(f[0], f[3]) for f in ts.analyse(src)] == want


@pytest.mark.parametrize("body,want", [("{ if (a) { if (b) { } } }", 3), ("{ if (a) { } else if (b) { } }", 3), ("{ if (a && b && c || d) { } }", 3), ("{ while (a) { do { x } while (b) } }", 3 + 2), ("{ a ?? b }", 1)])
def test_cognitive(body, want):
    assert ts.cognitive(body) == want


def test_spans():
    assert ts.analyse("\nfunction f() {\n\n}\n")[0][1:3] == (2, 4)


@pytest.mark.parametrize("src", ["'a", "`a", "/* a", "f(", "x = /a\n", "x = <a b={c", ")"])
def test_broken(src):
    with pytest.raises(ValueError):
        ts.analyse(src)

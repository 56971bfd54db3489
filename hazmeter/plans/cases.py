"""Sources, coverage texts and options written for one rule each, with what the rules make of them, derived by hand.

The queries spread each case over the rows of a table; the SQL states the results as literal rows.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Case:
    """A source and its functions: (name, first line, last line, cyclomatic, cognitive); or the error it ends in."""

    language: str
    name: str
    source: str | bytes
    functions: tuple[tuple[str, int, int, int, int], ...] = ()
    error: str | None = None
    features: tuple[str, ...] = ()

    @property
    def content(self) -> bytes:
        return self.source if isinstance(self.source, bytes) else self.source.encode()


GO_NOISE = """package p

func Label(a, b int) int {
	s := "if && for" + `case || if
	for`
	r := '"'
	// if a && b {
	/* for { case } */
	return len(s) + int(r) + a
}
"""
GO_WALK = """package p

func (t *Tree[K]) Walk(n int) (int, error) {
	for i := 0; i < n; i++ {
		if i > 2 && n > 3 || i == 0 {
			n--
		}
	}
	switch {
	case n > 1:
		return n, nil
	default:
	}
	return 0, nil
}

func (Leaf) pick(a, b int) int {
	if a > 0 {
		return 1
	} else if b > 0 {
		return 2
	} else {
		return 3
	}
}
"""
GO_SHAPES = """package p

func Convert[T any](x T) T { return x }

func Anything(x int) interface{} { if x > 0 { return x }; return nil }

func closure() { run := func(a bool) bool { if a { return a }; return !a }; run(true) }

func outer(a bool) {
	func inner(b bool) {
		for b {
			if a {
			}
		}
	}
	select {
	case <-c:
	}
}
"""
TS_NOISE = """export function view(a: boolean, items: string[]) {
  const re = /if (&&|\\/)[/]/g;
  const s = `if ${a ? 'x && y' : `for ${items.length}`} case`;
  // if (a) {}
  /* a || b */
  return <ul className="if && for">{items}<li>while</li></ul>;
}
"""
TS_CLASS = """class Box extends Base<T> {
  constructor(private v: T, n?: number) { super(); if (n) { this.size = n; } }
  static async load(p: string): Promise<void> { for (const x of p) { await x; } }
  get value(): T { return this.v ?? null; }
  set value(x: T) { this.v = x; }
  ['a' + 'b']() { return 1; }
  @log() protected override quiet(): void { }
  each<U>(f: U) { if (f) { } }
}
class Generic<T> { lost() { } }
"""
TS_NESTED = """const run = async (a: number): Promise<number> => {
  function hidden(b) { if (b) { } }
  return a ? 1 : 2;
};
const tiny = (x) => x || 1;
function shell(a) { function core(b) { if (b) { } } if (a) { } }
export default function wide(a) {
  function part(b) {
    if (b) { }
  }
  while (a?.b) { a ??= a && a.next; }
}
let late = function () { };
"""
TS_LOOPS = """function loops(x: any) {
  do { x--; } while (x > 0);
  switch (x) { case 1: break; case 2: break; default: }
  try { x(); } catch (e) { if (e) { } }
}
"""
PY_JOB = '''import os

class Job:
    """def ghost(): pass"""

    @property
    def state(self, a=1 if os else 0):
        # if and or
        text = f'if {a} and' + "for"
        return [x for x in text if x] or None

    async def run(self, xs):
        async for x in xs:
            if x and x > 1 or not x:
                continue
            elif x:
                break
            else:
                pass
        try:
            pass
        except (ValueError, KeyError):
            return 0
        def helper(y):
            while y: y -= 1
        return helper


def tail(): return lambda q: q if q else 0
'''
PY_ODD = '''class Outside:
    class Inside:
        def deep(self):
            for a in self:
                with a:
                    match a:
                        case 1:
                            pass
                        case _:
                            pass

    def flat(self): pass

def told():
    """
    def quoted():
        pass
    """
    return '\\\\' + rb"if" * 2

def broken
class :
'''
RUST_ITEMS = """struct S;
impl<'a> fmt::Display for &'a mut S {
    #[inline]
    fn fmt(&self) -> u8 {
        fn inside(a: bool) -> u8 { if a { 1 } else { 0 } }
        inside(true)
    }
}
impl Shape for [u8; 4] { fn area(&self) -> u8 { 4 } }
trait Shape { fn area(&self) -> u8 { if self.big() { 2 } else { 1 } } }
#[cfg(test)]
mod checks { fn gone() {} }
#[tokio::test]
fn also_gone() {}
#[cfg(all(unix, not(windows)))]
fn kept() {}
#[cfg(any())]
fn never() {}
#[cfg(not())]
fn always() {}
mod tests { fn hidden() {} }
#[cfg(feature = "fast")]
fn quick() {}
#[cfg(feature = "slow")]
fn slow() {}
#[cfg(target_os = "linux")]
fn here() {}
"""
RUST_DECIDE = """fn decide(x: Option<u8>, v: &[u8]) -> Result<u8, E> {
    let Some(y) = x else { return Err(E); };
    let z = match y {
        0 | 1 => 0,
        n if n > 9 && n < 99 => n,
        _ => v.iter().filter(|w| **w > 1 || **w == 0).count() as u8,
    };
    assert!(z > 0 && y > 0);
    'outer: loop {
        while z > y { continue 'outer; }
        break;
    }
    let text = r#"if "&&" for"#;
    opaque!(@@ if);
    Ok(parse(text)?)
}
"""

SCANS = (
    Case("go", "noise", GO_NOISE, (("Label", 3, 10, 1, 0),)),
    # for + if + && + || + case + default; the for's header holds semicolons, so its body is not nested; of a receiver
    # without a name the type is taken for the name
    Case("go", "walk", GO_WALK, (("Tree.Walk", 3, 15, 7, 5), ("pick", 17, 25, 3, 4))),
    # no row for the generic function; the braces of interface{} are taken for the body; inner is masked in outer
    Case("go", "shapes", GO_SHAPES, (("Anything", 5, 5, 1, 0), ("closure", 7, 7, 2, 1), ("outer", 9, 19, 2, 1), ("inner", 10, 15, 3, 3))),
    Case("go", "tagged out", "//go:build windows\n\npackage p\n\nfunc f() { }\n"),
    Case("go", "open string", 'package p\nfunc f() { x := "open }\n', error="unclosed string"),
    Case("go", "open comment", "package p\n/* func f() { }\n", error="unclosed comment"),
    Case("go", "unbalanced", "package p\nfunc f( { }\n", error="unbalanced braces"),
    Case("go", "no text", b"package p\n\xff\n", error="'utf-8' codec can't decode byte 0xff in position 10: invalid start byte"),
    # strings, templates, expressions and tags hold nothing that counts, but the text between two tags does
    Case("typescript", "noise", TS_NOISE, (("view", 1, 7, 2, 1),)),
    # a generic method is not found, but the if in it is taken for one; a generic class is not found
    Case("typescript", "class", TS_CLASS, (("Box.constructor", 2, 2, 2, 1), ("Box.load", 3, 3, 2, 1), ("Box.get value", 4, 4, 2, 1), ("Box.set value", 5, 5, 1, 0), ("Box.['a' + 'b']", 6, 6, 1, 0), ("Box.quiet", 7, 7, 1, 0), ("Box.if", 8, 8, 1, 0))),
    # nothing inside an assigned function is a row; on one line nothing is masked; an assigned function begins with the
    # line end before it
    Case("typescript", "nested", TS_NESTED, (("run", 1, 4, 3, 1), ("shell", 6, 6, 3, 2), ("core", 6, 6, 2, 1), ("wide", 7, 12, 4, 3), ("part", 8, 10, 2, 1), ("late", 12, 13, 1, 0))),
    Case("typescript", "loops", TS_LOOPS, (("loops", 1, 5, 7, 6),)),
    Case("typescript", "open string", "const a = 'x", error="unclosed string"),
    Case("typescript", "open regex", "x = /a\n", error="unclosed regex"),
    Case("typescript", "open tag", "x = <a b={c", error="unclosed jsx"),
    Case("typescript", "unbalanced", "function f() { ) }", error="unbalanced braces"),
    # the default of a parameter counts, as the body begins at def; async for is no control word of the cognitive rule
    Case("python", "job", PY_JOB, (("Job.state", 7, 10, 5, 1), ("Job.run", 12, 26, 7, 7), ("Job.helper", 24, 25, 2, 1), ("tail", 29, 29, 2, 0))),
    # a line of a docstring that begins with def is a row
    Case("python", "odd", PY_ODD, (("Inside.deep", 3, 10, 4, 6), ("Outside.flat", 12, 12, 1, 0), ("told", 14, 19, 1, 0), ("quoted", 16, 17, 1, 0))),
    Case("python", "mixed indent", "def f():\n \tpass\n", error="mixed tabs and spaces in indentation"),
    Case("python", "open string", "x = 'a\n", error="unclosed string"),
    Case("python", "unbalanced", "def f(:\n    pass\n", error="unbalanced braces"),
    # defaults of a trait are no rows; test items, modules named tests and conditions that do not hold go
    Case("rust", "items", RUST_ITEMS, (("&mut S::fmt", 4, 7, 1, 0), ("inside", 5, 5, 2, 2), ("[u8; _]::area", 9, 9, 1, 0), ("kept", 16, 16, 1, 0), ("always", 20, 20, 1, 0), ("quick", 23, 23, 1, 0), ("here", 27, 27, 1, 0)), features=("fast",)),
    # let-else, three arms, guard, && in it, || in the closure, && in the first macro, loop, while, ?; the second macro's
    # arguments are no expression
    Case("rust", "decide", RUST_DECIDE, (("decide", 1, 16, 12, 11),)),
    Case("rust", "open string", 'fn f() { "a }', error="unclosed string"),
    Case("rust", "unbalanced", "fn f( {}", error="unbalanced braces"),
)

#: Go sources by constraint: whether they are scanned without tags, and with the tag ``fancy``.
TAGGED = (
    ("plain", "package p\n", True, True),
    ("host", "//go:build linux && !windows\n\npackage p\n", True, True),
    ("unix", "// a licence\n\n//go:build unix\npackage p\n", True, True),
    ("machine", "//go:build amd64\npackage p\n", False, False),
    ("cgo", "//go:build cgo || plan9\npackage p\n", False, False),
    ("own tag", "//go:build fancy\npackage p\n", False, True),
    ("negated", "//go:build !fancy\npackage p\n", True, False),
    ("brackets", "//go:build (fancy || linux) && !(darwin || windows)\npackage p\n", True, True),
    ("last line wins", "//go:build windows\n//go:build linux\npackage p\n", True, True),
    ("old form, all lines", "// +build linux darwin\n// +build fancy\n\npackage p\n", False, True),
    ("old form, comma is no and", "// +build linux,fancy\n\npackage p\n", False, False),
    ("new form wins", "// +build windows\n//go:build linux\npackage p\n", True, True),
    ("after the package", "package p\n//go:build windows\n", True, True),
    ("cannot be read", "//go:build (linux\npackage p\n", False, False),
    ("rest is ignored", "//go:build linux )\npackage p\n", True, True),
)

#: LCOV texts, their records (path, line, hits, error) and how many are valid.
LCOV = (
    ("tab in a path", "SF:src/a\tb.rs\nDA:1,1\n", (("src/a\tb.rs", 1, 1, None),)),
    ("blanks around", " SF: src\\x.rs \r\n\tDA:2,3,sum\r\nDA:2,4\nend_of_record\r\n", (("src/x.rs", 2, 3, None), ("src/x.rs", 2, 4, None))),
    ("no file", "TN:t\nDA:1,1\n", ((None, 1, 1, "DA record without SF: DA:1,1"),)),
    ("after the end", "SF:a\nDA:9,0\nend_of_record\nDA:1,1", (("a", 9, 0, None), (None, 1, 1, "DA record without SF: DA:1,1"))),
    ("malformed", "SF:a\nDA:1,1\nDA:x,1\nDA:2\nDA: 1,1", (("a", 1, 1, None), ("a", None, 1, "malformed DA record: DA:x,1"), ("a", 2, None, "malformed DA record: DA:2"), ("a", None, 1, "malformed DA record: DA: 1,1"))),
    ("unknown records", "FN:1,f\nSF:a\nBRDA:1,0,0,1\nDA:7,5\nLF:1\nSF:b\nDA:1,0\nend_of_record\n", (("a", 7, 5, None), ("b", 1, 0, None))),
    ("bounds", "SF:a\nDA:1,18446744073709551616\nDA:4294967296,1\nDA:+3,+4\nDA:-1,1", (("a", 1, None, "malformed DA record: DA:1,18446744073709551616"), ("a", None, 1, "malformed DA record: DA:4294967296,1"), ("a", 3, 4, None), ("a", None, 1, "malformed DA record: DA:-1,1"))),
    ("mark in other places", "SF:src/end_of_record.rs\nDA:1,1\nend_of_record_x\nDA:2,1\n  end_of_record  \nSF:z\nDA:3,0", (("src/end_of_record.rs", 1, 1, None), ("src/end_of_record.rs", 2, 1, None), ("z", 3, 0, None))),
    ("nothing", "garbage\n", ()),
    ("file without lines", "SF:a\nend_of_record\n", ()),
)

#: Coverprofiles and their rows (place, mode, path, start, end, hits, error).
PROFILES = (
    ("good", "mode: set\na.go:1.1,2.2 1 7\n\n a.go:2.1,2.5 1 0 \n", ((1, "set", "a.go", 1, 2, 7, None), (3, "set", "a.go", 2, 2, 0, None))),
    ("columns are not read", "mode:atomic\nC:\\w\\a.go:1.x,2.y 1 1", ((1, "count", "C:/w/a.go", 1, 2, 1, None),)),
    ("blank in a path", " mode:  count \r\na b.go:3.1,3.9 2 1\r\n", ((1, "count", "a b.go", 3, 3, 1, None),)),
    ("tabs between fields", "mode: count\na.go:1.1,2.2\t1\t1", ((1, "count", None, None, None, None, "malformed coverprofile line: a.go:1.1,2.2\t1\t1"),)),
    ("two blanks before the hits", "mode: count\na.go:1.1,2.2 1  1", ((1, "count", "a.go", 1, 2, 1, "malformed coverprofile line: a.go:1.1,2.2 1  1"),)),
    ("two blanks before the statements", "mode: count\na.go:1.1,2.2  1 1", ((1, "count", "a.go", 1, 2, 1, None),)),
    ("no column", "mode: count\na.go:1,2.2 1 1", ((1, "count", None, None, None, None, "malformed coverprofile line: a.go:1,2.2 1 1"),)),
    ("line zero", "mode: count\na.go:0.1,2.2 1 1", ((1, "count", "a.go", 0, 2, 1, "malformed coverprofile line: a.go:0.1,2.2 1 1"),)),
    ("backwards", "mode: count\na.go:3.1,2.2 1 1", ((1, "count", "a.go", 3, 2, 1, "malformed coverprofile line: a.go:3.1,2.2 1 1"),)),
    ("too long", "mode: count\na.go:1.1,1000001.2 1 1\nb.go:1.1,1000000.2 1 1", ((1, "count", "a.go", 1, 1000001, 1, "malformed coverprofile line: a.go:1.1,1000001.2 1 1"), (2, "count", "b.go", 1, 1000000, 1, None))),
    ("odd mode", "mode: odd\na.go:1.1,2.2 1 1", ((0, None, None, None, None, None, "missing or unknown coverprofile mode"), (1, None, "a.go", 1, 2, 1, "missing or unknown coverprofile mode"))),
    ("no mode", "a.go:1.1,2.2 1 1", ((0, None, "a.go", 1, 2, 1, "missing or unknown coverprofile mode"),)),
    ("two modes", "mode: set\nmode: set\na.go:1.1,1.2 1 1", ((1, "set", None, None, None, None, "malformed coverprofile line: mode: set"), (2, "set", "a.go", 1, 1, 1, None))),
    ("empty", "", ((0, None, None, None, None, None, "missing or unknown coverprofile mode"),)),
)

#: Command lines and what they are read as: metric, threshold, policy, format, coverage, path; or the exit code.
COMMANDS = (
    ("--language go", "cyclomatic 15.0 pessimistic text cover.out ."),
    ("--language rust", "cyclomatic 15.0 pessimistic text lcov.info ."),
    ("--language rust --lcov x.info --path src --metric cognitive", "cognitive 15.0 pessimistic text x.info src"),
    ("--language python --threshold strict --missing skip --format json", "cyclomatic 8.0 skip json lcov.info ."),
    ("--language typescript --threshold lenient --missing optimistic", "cyclomatic 25.0 optimistic text lcov.info ."),
    ("--language go --threshold 12.5 --tags a,b --fail-above --summary", "cyclomatic 12.5 pessimistic text cover.out ."),
    ("--language go --threshold -1", "exit 2"),
    ("--language go --threshold nan", "exit 2"),
    ("--language go --metric Cyclomatic", "exit 2"),
    ("--language go --missing never", "exit 2"),
    ("--language go --format yaml", "exit 2"),
    ("--language go --workspace -p x", "exit 2"),
    ("--language go --summary --format json", "exit 2"),
    ("--language go --bogus --version", "exit 0"),
    ("--metric nonsense -h", "exit 0"),
    ("--language cobol", "exit 2"),
)

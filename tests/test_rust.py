"""The Rust scanner on functions written for its rules; what each counts is summed up beside it."""

import pytest

from hazmeter.sources import scan_rust as rs

FUNCTIONS = [
    # let-else, for, if, ||, ? | let-else 2, for 1, if inside 2, || 1
    ("fn pay(o: &Order) -> Result<Slip, E> { let Some(card) = o.card else { return Err(E::Card) }; for i in &o.items { if i.stock == 0 || i.price < 0 { return Err(E::Item); } } charge(card)?; Ok(slip(o)) }", 6, 6),
    # four arms, guard, &&, if | match 1, guard 1, && 1, if inside 2, else 1
    ("fn grade(score: u32, bonus: bool) -> char { match score { 90..=100 => 'a', s if bonus && s > 80 => 'a', 70..=89 => if bonus { 'b' } else { 'c' }, _ => 'f' } }", 8, 6),
    # loop, while, &&, if, loop | 1, 2, 1, 3, labelled break 1, 2
    ("fn spin(mut n: i32) { 'hot: loop { while n > 0 && n < 9 { n -= 1; if n == 4 { break 'hot; } } loop { break; } } }", 6, 10),
    # if | in a closure 2, else 1
    ("fn pick(v: &[u8]) -> usize { v.iter().filter(|b| if **b > 3 { true } else { **b == 0 }).count() }", 2, 3),
    # nine operators | 1, brackets begin anew 2, || with && inside 2, 1
    ("fn logic(a: bool, b: bool, c: bool) -> bool { let x = a && b && c; let y = a && (b && c); let z = a || b && c || a; x || y || z }", 10, 6),
    # four ifs | 1, else if 1, else if 1, if inside 2, else 1, else 1
    ("fn chain(x: i32) -> i32 { if x > 0 { 1 } else if x == 0 { 0 } else if x < -9 { if x < -99 { -2 } else { -1 } } else { 5 } }", 5, 7),
    # nothing: types, generics, literals, comments, patterns
    ('fn calm<\'a, T: ?Sized>(f: &\'a dyn for<\'b> Fn(&\'b str), Pair { a, .. }: Pair) -> impl Fn() + use<\'a, T> { /* if /* && */ || */ let s = r##"if "# && "##; let c = \'"\'; let b = b"for\\"while"; &&a }', 1, 0),
    # the arguments of two macros are read, the third's are no expression | the if 1, && 1
    ("fn macros(a: bool, b: bool) { check!(if a { 1 } else { 2 }); vec![a && b; 3]; table!(if => a, => b); }", 3, 3),
]


@pytest.mark.parametrize("source,cyclomatic,cognitive", FUNCTIONS)
def test_counts(source, cyclomatic, cognitive):
    assert rs.analyse(source, "cyclomatic")[0][3] == cyclomatic and rs.analyse(source, "cognitive")[0][3] == cognitive


def names(src, **options):
    return [f[0] for f in rs.analyse(src, **options)]


def test_items():
    src = """
use std::fmt;
struct Till<T> { count: u32, key: fn(T) -> u32 }
impl<T> Drop for Till<T>
where
    T: Clone,
{
    #[cold]
    fn drop(&mut self) {
        const fn coin() -> u32 { 1 }
        self.count -= coin();
    }
}
pub(super) unsafe extern "C" fn open<const N: usize>(x: [u8; N]) -> [u8; N] { x }
extern "C" { fn outside(); }
macro_rules! shop { ($x:expr) => { fn inside_macro() {} } }
static RATE: u32 = { fn rate() -> u32 { 2 } 2 };
trait Sell { fn price(&self) -> u32 { fn base() -> u32 { 3 } base() } fn name(&self); }
mod back { pub mod room { pub async fn rest() {} } }
"""
    assert names(src) == ["Till::drop", "coin", "open", "rate", "base", "rest"]
    assert rs.analyse(src)[0][1:3] == (9, 12)


@pytest.mark.parametrize(
    "head,want",
    [("shop::Till<u8>", "Till"), ("Sell for (Till, u8)", "(Till, u8)"), ("Sell for [Till]", "[Till]"), ("Sell for *mut Till", "*mut Till"), ("Sell for *const Till", "*const Till"), ("Sell for &'static Till", "&Till"), ("Sell for dyn Open + Sync", "dyn Open"), ("Sell for fn() -> u8", "<impl>"), ("Sell for <Till as Open>::Key", "Key")],
)
def test_owner_names(head, want):
    assert names(f"impl {head} {{ fn go() {{}} }}") == [f"{want}::go"]


def test_conditions():
    gone = ['#[cfg(target_os = "none")]', "#[cfg(all(unix, test))]", "#[cfg(not(any(unix, windows)))]", "#[cfg(proc_macro)]", "#[cfg(unheard_of)]", "#[cfg(unix)] #[cfg(windows)]", "#[a::b::test]", "#[bench]"]
    for attribute in gone:
        assert names(f"{attribute} fn left_out() {{ fn with_it() {{}} }} fn stays() {{}}") == ["stays"], attribute
    for attribute in ('#[cfg(target_pointer_width = "64")]', "#[cfg(any(windows, unix))]", "#[cfg(all())]", '#[cfg_attr(windows, path = "w.rs")]', "#[doc = \"test\"]"):
        assert names(f"{attribute} fn stays() {{}}") == ["stays"], attribute
    assert names('#[cfg(any(feature = "a", feature = "b"))] fn f() {}', features=["b"]) == ["f"]
    assert names('#[cfg(target_arch = "riscv")] fn f() {}', host={"target_arch": "riscv"}) == ["f"]


@pytest.mark.parametrize("src", ["fn a() { 'x }' }", "fn a() { /* /* */ }", "fn a(] {}", "fn a() { r#\"b\" }"])
def test_broken(src):
    with pytest.raises(ValueError):
        rs.analyse(src)


def test_deep_nesting():
    assert rs.analyse("fn deep() {" + "while a {" * 2500 + "}" * 2500 + "}")[0][3] == 2501

"""Small tables with nulls, empty texts, ties, repeated rows and clashing columns, against brute force."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hazmeter.llm import common, decontaminate, exact_dedup, language_id, packing, pii, registry, secret_scan, simhash

from .conftest import table
from .test_near_copies import groups_of

SF = "/root/testdata/sf0.001"


def test_exact_dedup(spark, odd, empty):
    rows, df = odd
    for block in (7, 4096):
        got = exact_dedup.exact_dedup(df, block=block).collect()
        groups = collections.defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        want = collections.Counter()
        for i, t in rows:
            g = groups[t or ""]
            want[i, max((x for x in g if x is not None), default=None), len(g), hashlib.sha256((t or "").encode()).hexdigest()] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)
        assert all(r.doc_id == r.keep_id for r in got if r.kept)
    assert exact_dedup.exact_dedup(empty).count() == 0
    kept = exact_dedup.keep_distinct(df)
    assert kept.columns == df.columns and kept.count() == len({t or "" for _, t in rows}) and exact_dedup.keep_distinct(empty).count() == 0


def components_of(ids, fps):
    root = simhash._roots(len(fps), *np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3))
    least = {}
    for i, r in zip(ids, root.tolist()):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return [least.get(r) for r in root.tolist()]


def test_simhash(spark, odd, empty):
    rows, df = odd
    fps = np.array([simhash.fingerprint(t) for _, t in rows], dtype=np.uint64)
    want = collections.Counter(zip([i for i, _ in rows], fps.view(np.int64).tolist(), components_of([i for i, _ in rows], fps)))
    assert collections.Counter((r.doc_id, r.fp, r.component_id) for r in simhash.simhash_groups(df).collect()) == want
    assert simhash.fingerprint("A b\tC") == simhash.fingerprint("a B c") and simhash.fingerprint(" ") == 0 == simhash.fingerprint(None)
    assert simhash.simhash_groups(empty).count() == 0


def test_simhash_index(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 20, dtype=np.uint64)
    flip = lambda n: np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
    fps = np.unique(np.r_[base[rng.integers(0, 20, 900)] ^ flip(900) ^ flip(900), rng.integers(0, 300, 200).astype(np.uint64)])
    want = dict(zip(fps.view(np.int64).tolist(), components_of(fps.view(np.int64).tolist(), fps)))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for cell in (16_384, 150):
        got = {r.node: r.comp for r in common.components(simhash.links(df, cell=cell)).collect()}
        assert all(got.get(f, f) == c for f, c in want.items())


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)] + [(9999, k) for k in range(700, 760)] + [(5, 5)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((top(u), top(v)))
            parent[b] = a
    assert got == {x: top(x) for x in parent}


def test_language(spark, odd, empty):
    rows, df = odd
    docs = common.documents(spark, SF)
    out = registry.QUERIES["op8_language_id"](spark, SF).toPandas().merge(docs.toPandas(), on="doc_id")
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    assert (out[out.held_out].lang == out[out.held_out].lang_pred).mean() > 0.95
    model = language_id.learn(docs)
    got = language_id.predict(df, model).collect()
    assert len(got) == len(rows) and all((r.lang_pred == "und") == (not language_id.has_letter(t)) and 0 <= r.score <= 1 for r, (_, t) in zip(got, rows))
    assert language_id.predict(empty, model).count() == 0 and language_id.learn(df).langs == []
    labelled = empty.unionByName(df.withColumn("lang", F.lit("en")))
    kept = language_id.keep_known(labelled)
    assert kept.columns == df.columns and kept.count() == sum(language_id.has_letter(t) for _, t in rows) and language_id.keep_known(empty).count() == 0
    # pieces of a long text count the n-grams of the whole, each once
    for text in ("Ab cd é " * 300, "x" * 2000, " 1 ".join("abc" * 5 for _ in range(200)), "İ" * 500):
        for piece in (7, 101, 1 << 18):
            old, language_id.PIECE = language_id.PIECE, piece
            try:
                counts = language_id.count_grams([text, "b" * 50], [0, 1], 2, 1 << 12)
            finally:
                language_id.PIECE = old
            want = np.zeros((2, 1 << 12), dtype=np.int64)
            for k, t in enumerate((text, "b" * 50)):
                c = re.sub(r"[^a-z\u00aa-\u00d6\u00d8-\u00f6\u00f8-\U0010ffff]+", " ", f" {t.lower()} ")
                for n in language_id.ORDERS:
                    for i in range(len(c) - n + 1):
                        h = n
                        for x in c[i : i + n]:
                            h = (h ^ ord(x)) * 2654435761 % 2**32
                            h ^= h >> 15
                        want[k, h % (1 << 12)] += 1
            assert (counts == want).all()


def test_language_brute_force(spark):
    """Counts, probabilities and choice of a plain naive Bayes over the same buckets."""
    rows = [(r.doc_id, r.text, r.lang) for r in common.documents(spark, SF).collect()]
    learned = [(t, x) for i, t, x in rows if zlib.crc32(str(i).encode()) % 3 != 1 and x is not None]
    langs = sorted({x for _, x in learned})

    def grams(t):
        c = re.sub(r"[^a-z\u00aa-\u00d6\u00d8-\u00f6\u00f8-\U0010ffff]+", " ", f" {t.lower()} ")
        for n in language_id.ORDERS:
            for i in range(len(c) - n + 1):
                h = n
                for x in c[i : i + n]:
                    h = (h ^ ord(x)) * 2654435761 % 2**32
                    h ^= h >> 15
                yield h % language_id.BUCKETS

    count = {x: collections.Counter() for x in langs}
    for t, x in learned:
        count[x].update(grams(t))
    total = {x: sum(count[x].values()) + 0.5 * language_id.BUCKETS for x in langs}
    got = {r.doc_id: r for r in registry.QUERIES["op8_language_id"](spark, SF).collect()}
    for i, t, _ in rows[:60]:
        g = list(grams(t))
        s = np.array([np.log(sum(y == x for _, y in learned) / len(learned)) + sum(np.log((count[x][b] + 0.5) / total[x]) for b in g) for x in langs]) / np.sqrt(len(g))
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        assert got[i].lang_pred == langs[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-3


def test_packing(spark, odd, empty):
    from tokenizers import Tokenizer

    rows, df = odd
    tok = Tokenizer.from_file(packing.vocabulary())
    out = packing.pack(df, size=64).toPandas()
    want = collections.Counter()
    for i, t in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 1]
        for k in range(0, len(ids), 64):
            want[i, k // 64, k, len(ids[k : k + 64]), zlib.crc32(np.array(ids[k : k + 64], "<u4").tobytes())] += 1
    assert collections.Counter((None if r.doc_id != r.doc_id else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()) == want
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *(g.offset + g.length).tolist()[:-1]] and (g.offset + g.length).max() <= 64
    assert packing.pack(empty).count() == 0
    # the counted plan fills as well as best fit over single pieces
    rng = random.Random(1)
    lengths = [rng.randrange(1, 65) for _ in range(3000)]
    runs = packing.plan(collections.Counter(lengths), 64)
    open_, n = [], 0
    for x in sorted(lengths, reverse=True):
        fit = min((r for r in open_ if r >= x), default=None)
        if fit is None:
            n, fit = n + 1, 64
        else:
            open_.remove(fit)
        open_.append(fit - x)
    assert runs["sequence"].max() + 1 <= n * 1.01 + 64


def test_encoder():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    for text in ("don't THING's <|endoftext|> É é É ﬁ ΣΑΣ. İx ß ... a..b !?. 12,3 x y\x1cz\tq it's.", "", "\n \n", "I'LL. we've? café, CAFÉ. 'S d'. Ａb２", "á. ́a ǅ, ʰ. µ ª"):
        for _ in range(2):
            assert enc.encode(text) == np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_encoder_bounds():
    import public_tokenizers

    enc = packing.Encoder(packing.vocabulary())
    before = len(enc.known)
    for k in range(50):
        enc.encode("x" * 500 + str(k))
    assert len(enc.known) <= before + 60 and max(map(len, enc.known)) <= 500
    with pytest.raises(ValueError):
        packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))


def test_decontaminate(spark, odd, empty):
    rng = random.Random(4)
    words = [w for t in common.documents(spark, SF).select("text").limit(40).collect() for w in t.text.split()]
    passage = " ".join(rng.choices(words, k=40))
    worn = passage[:60] + "x" + passage[62:120] + "yy" + passage[120:]
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, "Tiny one"), (5, " ".join(rng.choices(words, k=40)))], "item_id long, text string")
    docs = table(spark, [(1, "Before it. " + passage.upper() + " after"), (2, "a " + worn), (3, " ".join(rng.choices(words, k=4000))), (4, None), (5, ""), (6, "tiny ONE!"), (7, "a tiny one"), (8, "atiny one, tiny ones"), (None, passage)])
    got = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 1), (6, 4), (7, 4), (None, 1)} and (got[7, 4].start_at, got[7, 4].end_at) == (2, 10) and got[1, 1].distance == 0 and 0 < got[2, 1].distance <= 5
    assert (got[1, 1].start_at, got[1, 1].end_at) == (11, 11 + len(passage.rstrip(".,!"))) or got[1, 1].end_at in range(8 + len(passage), 12 + len(passage))
    one = decontaminate.find_leaks(docs, items, block=1)
    assert {(r.doc_id, r.item_id) for r in one.collect()} == set(got)
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(docs, items).collect()) == [3, 4, 5, 8]
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns and decontaminate.drop_leaks(empty, items).count() == 0
    assert decontaminate.drop_leaks(docs, items.limit(0)).count() == docs.count()
    assert decontaminate.find_leaks(empty, items).count() == 0 == decontaminate.find_leaks(docs, items.limit(0)).count()

    def dp(p, t):
        prev = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            cur = [i]
            for j, x in enumerate(t, 1):
                cur.append(min(prev[j] + 1, cur[-1] + 1, prev[j - 1] + (c != x)))
            prev = cur
        return min(prev)

    for _ in range(200):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abc", k=rng.randint(0, 30)))
        assert decontaminate.myers(decontaminate._peq(p), len(p), t)[0] == dp(p, t)


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_secrets(x):
    o = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    o += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(o + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def test_secrets(spark, odd, empty):
    rng = random.Random(6)
    al = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    texts = ["".join(rng.choices(["password", "Secret", "api_key", "token", ":", "=", " ", '"', "abc", "12", "AKIA", "ABCDEFGH12345678", "deadbeef0123", "é", "𝔘", "\n"], k=rng.randint(0, 25))) for _ in range(300)]
    secret = "".join(rng.choices(al, k=44))
    rows = list(enumerate(texts)) + [(1000, f"see {secret} here"), (1001, "internationalization_of_very-long-words-joined"), (1002, "1234567890" * 4), (None, None), (1003, "a1" * 40)]
    got = secret_scan.scan(table(spark, rows)).collect()
    want = collections.Counter((i, tuple(base_secrets(t or ""))) for i, t in rows)
    assert collections.Counter((r.doc_id, tuple((s.start, s.kind, s.end) for s in r.base)) for r in got) == want
    extra = {r.doc_id: [(s.start, s.end) for s in r.extra] for r in got if (r.doc_id or 0) >= 1000}
    assert extra == {1000: [(4, 48)], 1001: [], 1002: [], 1003: []}
    assert secret_scan.scan(empty).count() == 0 and secret_scan.scan(odd[1]).count() == len(odd[0])


def kinds_bound(token):
    n = len(token)
    counts = [sum(c in kind for c in token) for kind in secret_scan.KINDS]
    least = min(sum(o * math.log10(o / n / (x / sum(shares))) for o, x in zip(counts, shares) if o) for shares in secret_scan.ORDINARY)
    return min(0.0, math.log10(math.comb(n + 7, 7)) - least)


def test_battery(spark):
    """The tests' level on uniform draws, the bound on ordinary text, and what the whole finds among both."""
    rng = random.Random(12)
    words = sorted({w.strip(".,!?").lower() for r in common.documents(spark, SF).limit(100).collect() for w in r.text.split() if w.isascii() and w.strip(".,!?").isalpha()})
    encodings = {**secret_scan.ENCODINGS, "upper hex": "0123456789ABCDEF"}
    planted = [(name, n, "".join(rng.choices(al, k=n))) for name, al in encodings.items() for n in (20, 24, 32, 40, 64, 128) for _ in range(80)]

    def plain():
        out = rng.choice(words)
        while len(out) < 20:
            w = rng.choice(words)
            out += rng.choice(["_", "-", "/", ""]) + (w.capitalize() if rng.random() < 0.4 else w)
        return (out + str(rng.randrange(100)) if rng.random() < 0.2 else out).upper() if rng.random() < 0.1 else out

    ordinary = [plain() for _ in range(3000)] + ["".join(rng.choices("0123456789", k=rng.randrange(20, 40))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for *_, t in planted] + [(t,) for t in ordinary], "t string").select("t", secret_scan._battery(F.col("t")).alias("b")).collect()
    got = {r.t: r.b for r in df}
    for (*_, t), r in zip(planted, df):
        assert abs(r.b.log10_p - kinds_bound(t)) < 1e-6
    # the level of the battery holds up to three times itself at every length
    assert sum(got[t].p_random < secret_scan.ALPHA for *_, t in planted) <= 3 * secret_scan.ALPHA * len(planted) + 3
    # ordinary text: no token passes the bound at 10^-3 more often than that
    assert sum(got[t].log10_p <= -3 for t in ordinary) <= 3
    rows = [(k, f"see {t} here") for k, (*_, t) in enumerate(planted)] + [(10_000 + k, f"see {t} here") for k, t in enumerate(ordinary)]
    found = {r.doc_id: (len(r.base), len(r.extra)) for r in secret_scan.scan(table(spark, rows)).collect()}
    assert sum(found[k][1] for k in found if k >= 10_000) <= 5
    recall = collections.defaultdict(list)
    for k, (name, n, _) in enumerate(planted):
        recall[name, n].append(sum(found[k]) > 0)
    shares = {k: sum(v) / len(v) for k, v in recall.items()}
    for name in ("alnum", "base64"):
        assert all(shares[name, n] > 0.9 for n in (32, 40, 64, 128))
    assert shares["base32", 128] > 0.9 and all(shares["hex", n] == 1 for n in (24, 32, 40, 64, 128))


def base_private(x):
    o = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", x)]
    o += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", x) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", x):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0:
            o.append((m.start(), 2, m.end()))
    return sorted(o + [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", x) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15])


def test_private(spark, odd, empty):
    rng = random.Random(8)
    for _ in range(4000):
        text = "".join(rng.choices("a1.@-+ 5(9)_4é", k=rng.randint(0, 60)))
        assert pii.base_spans(text) == base_private(text)
    field = pii.train([r.text for r in common.documents(spark, "/root/testdata/sf0.01").collect()])
    for doc, want in (
        ("call +1 (743) 555-3824 or 555-3824 later, and 12 34567 items", ["555-3824"]), ("+1 (743) 555-3824 again: (743) 555-3824, also 743-555-3824; 7435553824!", ["(743) 555-3824", "743-555-3824", "7435553824"]),
        ("write to a.b@mail.example.org. Or a.b@mail, not c@mail", ["a.b@mail"]), ("+1 (743) 555-3824 or 555-3825", []), ("In 1984 there were 12 of 34.5 and 7.", []),
    ):
        base = pii.base_spans(doc)
        assert [doc[a:b] for a, _, b in pii.extra_spans(field, doc, base)] == want, (doc, [doc[a:b] for a, _, b in pii.extra_spans(field, doc, base)])
    assert pii.find(odd[1], field).count() == len(odd[0]) and pii.find(empty, None).count() == 0
    assert pii.train([]) is None
    # marginals on a tree are exact: against the sum over all labellings
    rng = np.random.default_rng(5)
    some = pii.Field(rng.normal(size=(4, 5)), rng.normal(size=(5, 5)), (m := rng.normal(size=(5, 5))) + m.T)
    feats, near, far = rng.normal(size=(5, 4)), [(0, 1), (1, 2)], [(0, 3), (2, 4)]
    for labels in ([0] * 5, [0, 0, 3, 0, 0]):
        total = np.zeros((5, 5))
        for y in itertools.product(range(5), repeat=5):
            if all(not o or o == v for o, v in zip(labels, y)):
                e = sum((feats[i] @ some.node)[v] for i, v in enumerate(y) if not labels[i]) + sum(some.step[y[i], y[j]] for i, j in near) + sum(some.skip[y[i], y[j]] for i, j in far)
                for i, v in enumerate(y):
                    total[i, v] += np.exp(e)
        assert np.abs(pii.marginals(some, feats, labels, near, far, 200) - total / total.sum(axis=1, keepdims=True)).max() < 1e-4
    assert pii.base_spans("1" * 200_000 + "a" * 200_000 + "@") == []  # linear time


def test_private_query(spark, empty, tmp_path):
    """The query's counts and digest against the plain patterns: spans of one kind in any place and number of a document."""
    email, ip, card, phone = "a.b@mail.example.org", "10.0.0.255", "4539 1488 0343 6467", "+1 (743) 555-3824"
    rng = random.Random(14)
    texts = [None, "", "no numbers", email, ip, card, phone, f"{email} {email} {email}", f"{phone}; {ip}, {email}", f"𝔘é {card}, {card} / {phone} 𝔘 {ip}", "10.0.0.256 4539 1488 0343 6468 +1 (7)", "; ".join([phone, card, ip, email] * 700)]
    texts += ["; ".join(rng.choices([email, ip, card, phone, "𝔘 12"], k=rng.randint(1, 9))) for _ in range(60)]
    rows = [*enumerate(texts), (3, ip), (3, ip), (None, phone), (None, None)]
    table(spark, rows).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    empty.write.parquet(str(tmp_path / "none" / "documents.parquet"))
    want = []
    for i, t in rows:
        base = base_private(t or "")
        want.append((i, *(sum(s[1] == k for s in base) for k in range(4)), hashlib.sha256(",".join(f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()))
    got = registry.QUERIES["op4_pii"](spark, str(tmp_path / "odd")).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256").collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(want)
    assert registry.QUERIES["op4_pii"](spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(spark, name):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    got, want = registry.QUERIES[name](spark, SF).toPandas(), con.execute(registry.ORACLES[name]).df()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    assert sorted(map(str, got[cols].itertuples(index=False, name=None))) == sorted(map(str, want[cols].itertuples(index=False, name=None)))


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.documents(spark, SF).toPandas()
    model = language_id.learn(common.documents(spark, SF))
    lang, score = language_id.score(model, docs.text.tolist())
    docs = docs[[a != "und" and b >= 0.5 for a, b in zip(lang, score)]]
    docs = docs.loc[docs.groupby("text").doc_id.idxmax()]
    docs = docs.sort_values("doc_id")
    docs = docs[[k == r for k, r in enumerate(groups_of(docs.text.tolist()))]]
    items = [(r.item_id, r.text) for r in decontaminate.benchmark(spark, SF).collect()]
    match = decontaminate.Matcher(items)
    keep = {i for i, t in zip(docs.doc_id, docs.text) if not match(t)}
    out = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in out.collect()} == keep and 0 < len(keep) < len(docs) + 1
    df = common.documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, SF)
        assert df.columns == common.documents(spark, SF).columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        none = stage(spark, df.limit(0), SF)
        assert none.count() == 0 and none.columns == df.columns

"""The licence classifier: columns against numpy, calibration, held-out variants, paragraphs and lines."""

import random
import re

import numpy as np
import pytest

from hazmeter.llm import license_scan as ls

from .conftest import table


def test_columns_give_the_model(spark):
    """What the columns find equals a plain version that scores every paragraph and line, without the search for words."""
    rng = random.Random(3)
    notices = [t for texts in ls.TEMPLATES.values() for t in texts]
    texts = []
    for k in range(60):
        lines = [rng.choice([rng.choice(notices), rng.choice(ls.FOREIGN), "Was ntonti theron the 12 erhe.", ""]) for _ in range(rng.randrange(6))]
        texts.append("\n".join(lines).replace(". ", rng.choice([". ", ".\n", ".\r\n"])))
    got = {r.doc_id: r for r in ls.scan(table(spark, list(enumerate(texts)))).collect()}
    told = set(ls.gate())
    for k, text in enumerate(texts):
        want = {}
        parts = [p for p in re.split(r"\n[ \t]*(?=\n)", re.sub(r"\r\n?", "\n", text)) if p.strip(" \t\n")]
        for i, p in enumerate(parts):
            lines = [x for x in p.split("\n") if x.strip(" \t")]
            for j, x in [(-1, p.replace("\n", " ")), *(enumerate(lines) if len(lines) > 1 else ())]:
                prob = ls.probabilities(x)
                if prob.argmax() or told & set(re.split("[^a-z0-9]+", x.lower())):
                    want[i, j] = prob
        assert got[k].n_paragraphs == len(parts)
        found = {(f.paragraph, f.line): f.c for f in got[k].found}
        assert set(found) == set(want)
        for at, c in found.items():
            assert abs(c.probability - want[at].max()) < 2e-4
            assert c.family == (ls.CLASSES[want[at].argmax()] if want[at].argmax() and want[at].max() >= ls.THRESHOLD else "unknown")


def test_held_out_variants():
    rng = random.Random(99)
    right = {c: [] for c in ls.TEMPLATES}
    for c, texts in ls.TEMPLATES.items():
        for t in texts:
            for v in ls._variants(rng, t, 6)[1:]:
                p = ls.probabilities(v)
                right[c].append(ls.CLASSES[p.argmax()] == c and p.max() >= ls.THRESHOLD)
    shares = {c: np.mean(v) for c, v in right.items()}
    assert np.mean(list(shares.values())) > 0.8 and min(shares.values()) > 0.5, shares
    wrong = [v for t in ls.FOREIGN for v in ls._variants(rng, t, 6) if (p := ls.probabilities(v)).argmax() and p.max() >= ls.THRESHOLD]
    assert len(wrong) < 0.1 * 6 * len(ls.FOREIGN)


def test_calibration():
    heat, threshold = ls.calibrate()
    assert abs(heat - ls.HEAT) < 0.1 and abs(threshold - ls.THRESHOLD) < 0.1


def test_notices(spark):
    text = "Intro\n\nReleased under the MIT License.\nYou need a driving license now.\nLicensed under the Apache License, Version 2.0.\nMIT!! DER!!\n\nPermission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."
    found = ls.scan(table(spark, [(1, text)])).first()
    sure = {(f.paragraph, f.line): f.c.family for f in found.found if f.c.confirmed}
    assert found.n_paragraphs == 3 and sure[1, 0] == "mit" and sure[1, 2] == "apache" and sure[2, -1] == "isc" and (1, 1) not in sure
    # every notice is confirmed as its own family, no foreign paragraph as any
    rows = [(k, t) for k, (_, t) in enumerate((c, t) for c, texts in ls.TEMPLATES.items() for t in texts)] + [(1000 + k, t) for k, t in enumerate(ls.FOREIGN)]
    own = [c for c, texts in ls.TEMPLATES.items() for _ in texts]
    for r in ls.scan(table(spark, rows)).collect():
        sure = {f.c.family for f in r.found if f.c.confirmed}
        assert sure == (set() if r.doc_id >= 1000 else {own[r.doc_id]}), (r.doc_id, sure)


def test_odd_tables(spark, odd, empty):
    assert ls.scan(odd[1]).count() == len(odd[0]) and ls.scan(empty).count() == 0
    assert [r.n_paragraphs for r in ls.scan(table(spark, [(1, None), (2, ""), (3, " \n \n")])).orderBy("doc_id").collect()] == [0, 0, 0]

"""Fingerprints, licences, mixing, language and quality against brute force."""

import hashlib
import random

import numpy as np
import pytest

from quarry.llm import fingerprints, language, licenses, mixing, quality
from quarry.llm.common import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in rows], DOCS)


ODD = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "Ab  c", None, None), (4, "ab c", "en", "b"), (4, "ab c", "en", "b"), (5, "x " * 30_000, "de", "a"), (6, "!!! 123", "de", "b")]


def test_edits_match_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    rows = sorted(((r[0], r[1] or "") for r in docs.collect()), reverse=True)
    want = {}
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        want[doc_id] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), float(fingerprints.canonical(text) == fingerprints.canonical(other)))
    got = fingerprints.compare_with_edits(docs).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.near_next) for r in got} == want
    assert len(got) == len(rows)


def test_fingerprints_of_odd_rows(spark):
    docs = frame(spark, ODD)
    prints = fingerprints.compare_with_edits(docs)
    got = fingerprints.exact_groups(docs, prints).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r)
    assert by[1].fingerprint == by[2].fingerprint and by[1].group_id == 1 and by[1].group_size == 2
    assert by[3].fingerprint == by[4].fingerprint and by[3].group_size == 3
    assert fingerprints.exact_groups(docs.limit(0), fingerprints.compare_with_edits(docs.limit(0))).count() == 0


def test_digest_clash_is_separated_by_bytes(spark):
    grouped = spark.createDataFrame([(1, "f", 1, 3), (2, "f", 1, 3), (3, "f", 1, 3)], "doc_id long, fingerprint string, group_id long, group_size int")
    forms = spark.createDataFrame([(1, "f", "a"), (2, "f", "b"), (3, "f", "b")], "doc_id long, fingerprint string, form string")
    got = {r.doc_id: (r.fingerprint, r.group_id, r.group_size) for r in fingerprints._separated(grouped, forms).collect()}
    assert got == {1: ("f", 1, 1), 2: ("f-1", 2, 2), 3: ("f-1", 2, 2)}


def test_licenses(spark):
    rows = [
        (1, "Hello.\nLicensed under the Apache License, Version 2.0.\nBye", None, None),
        (2, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", None, None),
        (3, "a license is not a licence notice", None, None),
        (4, None, None, None),
        (5, "Released under the MIT License. Licensed under CC BY-NC 4.0.", None, None),
    ]
    got = {r.doc_id: (r.license, r.licenses) for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {1: ("Apache-2.0", "Apache-2.0"), 2: ("MIT", "MIT"), 3: (None, ""), 4: (None, ""), 5: ("MIT", "MIT,CC-BY-NC-4.0")}


@pytest.mark.parametrize("seed", range(3))
def test_mixing_stays_within_a_block_of_its_target(spark, seed):
    rng = random.Random(seed)
    weights = {"a": 1, "b": rng.randint(1, 5), "c": rng.randint(1, 9)}
    sizes = {k: rng.randint(5, 120) for k in weights} | {None: 7}
    rows = [(n, "t", "en", s) for n, s in enumerate(s for s, k in sizes.items() for _ in range(k))]
    got = mixing.schedule(frame(spark, rows), weights, block_rows=2).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.mix_slot, set()).add(r.source)
    assert sorted(slots) == list(range(len(slots))) and all(len(x) == 1 for x in slots.values())
    weights[None] = 1
    total, done = sum(weights.values()), dict.fromkeys(weights, 0)
    whole = min(-(-n // 2) // weights[s] for s, n in sizes.items()) * total  # all sources have supply
    for t in range(whole):
        done[next(iter(slots[t]))] += 1
        assert all(abs(done[s] - (t + 1) * w / total) < 1 for s, w in weights.items())
    assert len({(r.mix_slot, r.mix_row) for r in got}) == len(rows)


def test_mixing_empty(spark):
    assert mixing.schedule(frame(spark, ODD).limit(0)).count() == 0
    assert mixing.schedule(frame(spark, ODD)).count() == len(ODD)


def test_language_on_held_out_rows(spark):
    docs = {r.doc_id: r.lang for r in table(spark, SF, "documents").collect()}
    got = language.op7_language_id(spark, SF).collect()
    judged = [r for r in got if r.held_out and docs[r.doc_id] and r.lang_pred != "und"]
    assert len(got) == len(docs) and sum(docs[r.doc_id] == r.lang_pred for r in judged) >= 0.95 * len(judged)
    assert all(0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    docs = frame(spark, ODD)
    profiles = language.learn(docs)
    assert [x for x, _, _ in profiles] == ["de", "en"]
    assert language.predict("", profiles) == ("und", 0.0) and language.predict("123 !", profiles)[0] == "und"
    assert language.predict("x x", profiles)[0] == "de"
    assert language.learn(docs.limit(0)) == []
    kept = {r.doc_id for r in language.keep_identified(docs, profiles).collect()}
    assert kept == {3, 4, 5}


def test_language_counts_match_python():
    text = "Ab, ba!\nÄb"
    padded = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    padded = " ".join(padded.split()).join("  ")
    want = sorted([c for c in padded if c != " "] + [padded[i : i + 2] for i in range(len(padded) - 1)] + [padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " "])
    code = lambda s: sum(ord(c) << (21 * (len(s) - 1 - k)) for k, c in enumerate(s))
    assert sorted(language.grams(text).tolist()) == sorted(map(code, want))


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in table(spark, sf, "labels").collect()}
    got = [r for r in quality.op10_quality(spark, sf).collect()]
    judged = [r for r in got if r.held_out and r.doc_id in labels]
    hits = sum(r.predicted == labels[r.doc_id] for r in judged)
    print(hits, len(judged))
    assert hits >= 0.9 * len(judged)


def test_quality_trees_match_a_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    trees = quality.fit(x, y)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    for row, score in zip(x[:20], trees.score(x[:20]), strict=True):
        total = trees.base
        for f, c, v in zip(trees.feature, trees.cut, trees.value, strict=True):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += v[node - len(f)]
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def test_quality_of_odd_rows(spark):
    docs = frame(spark, ODD)
    labels = spark.createDataFrame([(1, 1), (None, 0), (2, None)], "doc_id long, quality int")
    trees = quality.train(docs, labels)
    assert 0 < trees.score(quality.feature_matrix(["", "a b"]))[0] <= 1
    assert quality.train(docs, labels.limit(0)).score(quality.feature_matrix([""]))[0] == 0.5


def plain_edf(shares):
    """Earliest deadline first over one round, slot by slot."""
    total, done, out = sum(shares), [0] * len(shares), []
    for t in range(total):
        open_ = [(-(-(d + 1) * total // a), k) for k, (a, d) in enumerate(zip(shares, done, strict=True)) if d < a and d * total // a <= t]
        k = min(open_)[1]
        done[k] += 1
        out.append(k)
    return out


def test_mixing_columns_may_be_called_anything(spark):
    names = ["k", "kind", "slot", "w", "total", "base", "turn", "mix_part", "mix_slot", "row", "n"]
    docs = spark.range(40).selectExpr("id as doc_id", "concat('s', id % 3) as source", *[f"id + 100 as {n}" for n in names])
    got = mixing.schedule(docs, {"s0": 1, "s1": 2, "s2": 3}, block_rows=1).collect()
    assert len(got) == 40 and all(r[n] == r.doc_id + 100 for r in got for n in names if n != "mix_slot")
    order = [int(r.source[1]) for r in sorted(got, key=lambda r: r.mix_slot)]
    assert order[:6] == plain_edf([1, 2, 3]) == order[6:12]
    null = docs.selectExpr("cast(null as bigint) as doc_id", "* except (doc_id)")
    assert mixing.schedule(null, block_rows=4).count() == 40

"""Registered queries without a SQL twin, called on a folder of odd rows, against plain loops."""

import hashlib
import random
import unicodedata

import pytest
import xxhash

from quarry.llm import registry
from tests.llm.test_joins import brute_tiles
from tests.llm.test_models import brute_scores


def plain(text):
    return "".join(c.lower() if c.isalnum() and c < "\x80" else c if c > "\x7f" else " " for c in text or "").split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("entries"))
    rng = random.Random(6)
    say = lambda n: " ".join(rng.choices([f"w{k}" for k in range(6)], k=n))
    items = [(k, say(rng.randint(1, 14))) for k in range(12)] + [(20, None), (21, ""), (22, "w0 w1 w0 w1 w0 w1"), (22, "w0 w1 w0 w1 w0 w1")]
    rows = [(k, say(rng.randint(0, 40))) for k in range(40)]
    rows += [(50, None), (51, ""), (52, "W0, w1! " * 400), (53, "Ａb  C"), (54, "ab c"), (54, "AB  C\n"), (55, "Straße"), (56, "STRASSE"), (None, "w1 w2"), (-3, "é"), (57, "é")]
    spark.createDataFrame([(i, t, None, 7) for i, t in rows], "doc_id long, text string, fingerprint string, place int").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(i, t, 1.5) for i, t in items], "item_id long, text string, coverage double").write.parquet(f"{out}/benchmark.parquet")
    return out, rows, items


def test_op1(spark, folder):
    out, rows, _ = folder

    def form(text):
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
        return " ".join(folded.split())

    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    forms = [form(t) for _, t in rows]
    want = []
    for k, (i, text) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        same = [j for (j, _), f in zip(rows, forms, strict=True) if f == forms[k]]
        digests = [xxhash.xxh3_128_hexdigest(x.encode()) for x in (forms[k], form(edited))]
        near = [float(forms[k] == form(x)) for x in (edited, after)]
        want.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), *digests, *near, min((j for j in same if j is not None), default=None), len(same)))
    got = registry.queries()["op1_document_fingerprints"](spark, out).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_op3(spark, folder):
    out, rows, items = folder
    want = []
    for i, text in rows:
        for k, item in items:
            w = plain(item)
            found = brute_tiles(w, plain(text), min(5, len(w))) if w else []
            covered = sum(n for _, _, n in found)
            if w and covered >= 0.5 * len(w):
                want.append((i, k, len(w), covered, len(found), max(n for _, _, n in found), covered / len(w)))
    got = registry.queries()["op3_benchmark_leaks"](spark, out).collect()
    assert want and sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_op4(spark, folder):
    out, rows, _ = folder
    got = sorted(map(tuple, registry.queries()["op4_lm_scores"](spark, out).collect()), key=repr)
    want = sorted(brute_scores(rows), key=repr)
    assert [x[:5] for x in got] == [x[:5] for x in want]
    assert all(abs(g[5] - w[5]) < 1e-6 for g, w in zip(got, want, strict=True))
    # two counts a token, each kept in steps of 1/4000 of a power of ten: at most half a step off
    off = [(g[0], g[6], w[6]) for g, w in zip(got, want, strict=True) if abs(g[6] - w[6]) > 2 * w[2] / 8000 + 1e-9]
    assert not off

"""Line dedup over words against brute force."""

import random
from collections import Counter

import numpy as np
import pytest

from quarry.llm import lines
from quarry.llm.common import table
from quarry.llm.wordjoin import pairs
from tests.llm.test_joins import frame, linked, near_copies, split


def tokens(text):
    seen = Counter()
    out = set()
    for w in split(text):
        out.add((w, seen[w]))
        seen[w] += 1
    return out


def brute_word_lines(rows):
    every = sorted((i, k, tokens(x)) for i, t in rows for k, x in enumerate((t or "").split("\n")))
    gone = {}
    for n, (i, k, s) in enumerate(every):
        if any(linked(s, e) for _, _, e in every[:n]):
            gone.setdefault(i, []).append(k)
    return gone


def test_one_changed_word_of_ten(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "a b c d X f g h i j\nother"), (3, "a a b"), (4, "a b b"), (5, "one two three four"), (6, "four three two one"), (7, "one two three four five")]
    got = {r.doc: r.lines for r in lines.removed_lines(frame(spark, rows)).collect()}
    assert got == {2: [0], 6: [0], 7: [0]} == brute_word_lines(rows)
    kept = {r.doc_id: r.text for r in lines.dedup(frame(spark, rows)).collect()}
    assert kept == {1: rows[0][1], 2: "other", 3: "a a b", 4: "a b b", 5: rows[4][1]}


@pytest.mark.parametrize("block", [1_500_000, 60])
def test_word_lines_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("quarry.llm.setjoin.BLOCK_TOKENS", block)
    rng = random.Random(9)
    pool = [t.replace("\n", " ") for _, t in near_copies(4, docs=25, copies=5)] + ["", "  ", "one", "one two"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 6)))) for i in range(60)] + [(61, None)]
    docs = frame(spark, rows).repartition(3)
    assert {r.doc: r.lines for r in lines.removed_lines(docs).collect()} == brute_word_lines(rows)
    assert lines.removed_lines(docs.limit(0)).count() == 0


def test_odd_rows_of_op6(spark, tmp_path):
    rows = [(1, "a b c d e\nd"), (None, "d\nlast"), (None, "last\nA B c d e"), (2, None), (2, ""), (3, "x " * 30_000), (4, "X " * 30_000)]
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_lines, r.removed_lines) for r in lines.op6_line_dedup(spark, str(tmp_path)).collect())
    # each row is a document; those without an id come last, by text
    assert got == [("1", 2, []), ("2", 1, []), ("2", 1, []), ("3", 1, []), ("4", 1, [0]), ("None", 2, [0]), ("None", 2, [0, 1])]


def test_rows_that_share_an_id_keep_what_no_earlier_line_has(spark):
    rows = [(1, "a b c d e\nfirst"), (7, "first\nunique line one two three"), (7, "other words here now then\na b c d e"), (9, "plain"), (None, "d\nlast"), (None, "last\nA b c d e"), (5, "copy"), (5, "copy"), ((1 << 63) - 1, "plain\ntop")]
    got = sorted((str(r.doc_id), r.text, r.n_chars) for r in lines.dedup(frame(spark, rows).repartition(4)).collect())
    want = [("1", rows[0][1]), ("5", "copy"), ("7", "other words here now then"), ("7", "unique line one two three"), ("9", "plain"), (str((1 << 63) - 1), "top"), ("None", "d\nlast")]
    assert got == sorted((i, t, len(t)) for i, t in want)


def test_op6_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = brute_word_lines([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert {r.doc_id: r.removed_lines for r in lines.op6_line_dedup(spark, sf).collect() if r.n_removed} == want


def test_pairs_connect_all_that_link():
    rng = np.random.default_rng(5)
    sets = []
    for _ in range(40):
        base = rng.permutation(40)[:12]
        sets += [np.unique(np.where(np.arange(12) == rng.integers(12), rng.integers(40), base)) for _ in range(5)]
    posted = [(t, k, len(s), at, int(np.bitwise_xor.reduce(1 << s)), 0) for k, s in enumerate(sets) for at, t in enumerate(s.tolist()[: len(s) - -(-len(s) * 80 // 100) + 1])]
    kinds = (np.uint64, np.int64, np.int32, np.int32, np.uint64, np.uint64)
    a, b = pairs(*(np.array(x, kind) for x, kind in zip(zip(*posted, strict=True), kinds, strict=True)))
    label = list(range(len(sets)))
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        label = [label[x] if z == label[y] else z for z in label]
    every = [(x, y) for x in range(200) for y in range(x) if linked(set(sets[x].tolist()), set(sets[y].tolist()))]
    assert every and all(label[x] == label[y] for x, y in every)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    table(spark, sf, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    table(spark, sf, "benchmark").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_dedup_hands_on_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "a b", 7, 8, 9), (2, "a b\nc", 7, 8, 9)], "doc_id long, text string, key_ int, lost_ int, lines int")
    got = sorted(tuple(r) for r in lines.dedup(docs).collect())
    assert got == [(1, "a b", 7, 8, 9), (2, "c", 7, 8, 9)]

"""Decontamination, the n-gram join and line dedup against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from quarry.llm import decontaminate, jaccard, lines
from quarry.llm.common import table
from quarry.llm.components import components, forest
from quarry.llm.tokens import words

BLANK = " \t\n\x0b\x0c\r"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component string, node int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "c", 1) for i, t in rows], DOCS)


def split(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in BLANK:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def shingles(text):
    w = split(text)
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def linked(a, b):
    return bool(a and b) and 100 * len(a & b) >= 80 * len(a | b)


def brute_components(rows):
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    ids = sorted(sets)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if linked(sets[a], sets[b])]
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            low = min(label[a], label[b])
            moved |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in ids}


def near_copies(seed, docs=40, copies=8):
    rng = random.Random(seed)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(60)]
    passage = rng.choices(vocab, k=40)
    out = []
    for _ in range(docs):
        base = rng.choices(vocab, k=rng.choice([3, 5, 12, 30, 80]))
        if rng.random() < 0.5:
            base = base + passage
        for _ in range(rng.randint(1, copies)):
            changed = list(base)
            for _ in range(rng.randint(0, 2)):
                changed[rng.randrange(len(changed))] = rng.choice(vocab)
            out.append(rng.choice([" ", "\n", "\t "]).join(changed))
    return list(enumerate(out))


def test_words_match_the_contract():
    texts = ["Ab  C\x0bd e", "", None, " ÀB\n", "x" * 10]
    offsets, index, dictionary = words(pa.array(texts).slice(1))
    got = [[dictionary[int(k)].as_py() for k in index[a:b]] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    assert got == [split(t) for t in texts[1:]]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = near_copies(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(frame(spark, rows).repartition(3)).collect()}
    assert got == brute_components(rows)


def test_components_match_when_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr("quarry.llm.setjoin.BLOCK_TOKENS", 300)
    rows = near_copies(5, docs=12, copies=25)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_components_of_the_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.link_components(docs).collect()}
    assert got == brute_components([(r.doc_id, r.text) for r in docs.collect()])


def test_odd_rows_of_the_join(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "a b"), (5, "A  b"), (None, "a b"), (6, "x " * 20_000), (7, "x " * 30_000), (7, "x " * 30_000)]
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.link_components(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (0, 1, None), (6, 1, 6), (7, 1, 6), (7, 1, 6)], key=str)
    assert jaccard.link_components(frame(spark, rows).limit(0)).count() == 0
    assert sorted(r.doc_id for r in jaccard.keep_first(frame(spark, rows).filter("doc_id is not null")).collect()) == [1, 2, 3, 4, 6]


def test_divide_skip_matches_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(4)]
        sets = []
        for _ in range(30):
            own = base[rng.integers(4)].copy()
            own[rng.integers(len(own))] = rng.integers(0, 80)
            sets.append(np.unique(own).astype(np.uint64))
        want = forest(*(np.array(x, dtype=np.int64) for x in zip(*[(a, b) for a in range(30) for b in range(a) if linked(set(sets[a].tolist()), set(sets[b].tolist()))] or [(0, 0)], strict=True)))
        got = jaccard.divide_skip(sets)
        have = forest(*(np.array(x, dtype=np.int64) for x in zip(*(got or [(0, 0)]), strict=True)))
        assert [x.tolist() for x in want] == [x.tolist() for x in have]


def test_dedup_changes_texts(spark):
    rows = [(1, "a b c\nd"), (2, "A b c\nnew\n"), (3, "d"), (None, "d\nlast"), (4, None)]
    got = {r.doc_id: (r.text, r.n_chars) for r in lines.dedup(frame(spark, rows)).collect()}
    assert got == {1: ("a b c\nd", 7), 2: ("new\n", 4), None: ("last", 4), 4: (None, 0)}
    assert lines.dedup(frame(spark, rows).limit(0)).count() == 0


def brute_tiles(item, text, least):
    """Greedy string tiling by comparing everything; of equal runs the least shift first."""
    used_i, used_t, out = set(), set(), []
    while True:
        best, found = least, []
        for i in range(len(item)):
            for t in range(len(text)):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and i + n not in used_i and t + n not in used_t:
                    n += 1
                if n > best or (n == best and n):
                    found = found + [(i, t, n)] if n == best else [(i, t, n)]
                    best = n
        if not found:
            return out
        for i, t, n in sorted(found, key=lambda x: (x[1] - x[0], x[1])):
            if not any(i + k in used_i or t + k in used_t for k in range(n)):
                used_i.update(range(i, i + n))
                used_t.update(range(t, t + n))
                out.append((i, t, n))


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_tiles_match_brute_force(most):
    rng = random.Random(2)
    for _ in range(120):
        item, text = ([rng.randrange(rng.choice([1, 2, 4])) for _ in range(n)] for n in (rng.randint(1, 14), rng.randint(0, 30)))
        got = decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3, most)
        assert got == brute_tiles(item, text, 3)


def test_tiles_of_texts_that_repeat_themselves():
    one = np.zeros(60_000, np.uint64)
    assert decontaminate.tiles(one[:3000], one, 5) == [(0, 0, 3000)]
    assert [n for _, _, n in decontaminate.tiles(one, one[:3000], 5)] == [3000]


def test_tiles_when_hashes_clash(monkeypatch):
    monkeypatch.setattr(decontaminate, "_BASE", 1)  # windows with the same sum of words clash
    monkeypatch.setattr(decontaminate, "_INVERSE", 1)
    rng = random.Random(3)
    for _ in range(60):
        item, text = ([rng.randrange(3) for _ in range(n)] for n in (rng.randint(3, 14), rng.randint(3, 30)))
        assert decontaminate.tiles(np.array(item, np.uint64), np.array(text, np.uint64), 3) == brute_tiles(item, text, 3)


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    parts = item.split()
    rows = [(1, f"x {item.upper()}, y"), (2, "z " + " ".join(parts[6:]) + " q " + " ".join(parts[:6])), (3, "one two three four"), (4, None), (5, "short"), (5, "so SHORT!")]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "short"), (10, "")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_tiles, r.coverage) for r in decontaminate.matches(frame(spark, rows), bench).collect())
    assert got == [(1, 7, 1, 1.0), (2, 7, 2, 1.0), (5, 9, 1, 1.0), (5, 9, 1, 1.0)]
    assert sorted(r.doc_id for r in decontaminate.keep_clean(frame(spark, rows), bench).collect()) == [3, 4]
    assert decontaminate.matches(frame(spark, rows).limit(0), bench).count() == 0
    assert decontaminate.matches(frame(spark, rows), bench.limit(0)).count() == 0
    assert [len(b) for b in decontaminate.blocks(bench, 6)] == [1, 3]


def test_leaks_of_the_table(spark):
    docs, bench = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, bench).collect()}
    whole = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if b.text in (d.text or "")}
    assert whole <= got


def test_connected_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1100)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long").repartition(5)).collect()}
    a, b = forest(*(np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True)))
    want = dict(zip(b.tolist(), a.tolist(), strict=True))
    assert got == {x: want.get(x, x) for p in pairs if p[0] != p[1] for x in p}

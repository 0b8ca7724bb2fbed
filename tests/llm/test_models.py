"""The language model, HTML extraction and the pipeline against brute force."""

import math
import random
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest

from quarry.llm import decontaminate, eliasfano, html, language, mixing, ngram_lm
from quarry.llm.common import table
from tests.llm.test_joins import brute_components, brute_tiles, frame, near_copies, split
from tests.llm.test_word_lines import brute_word_lines


def test_elias_fano_finds_all():
    rng = np.random.default_rng(1)
    for n, bits in ((0, 8), (1, 1), (1, 64), (700, 9), (5000, 30), (3000, 64), (3000, 47)):
        values = np.sort(rng.integers(0, 1 << bits, n, dtype=np.uint64, endpoint=False) if bits < 64 else rng.integers(0, (1 << 64) - 1, n, dtype=np.uint64))
        found = eliasfano.EliasFano(values, eliasfano.Levels())
        if n:
            assert found.access(np.arange(n)).tolist() == values.tolist()
        asked = np.concatenate((values, values + np.uint64(1), values - np.uint64(1), rng.integers(0, (1 << 64) - 1, 50, dtype=np.uint64)))
        known = set(values.tolist())
        place = found.find(asked)
        assert [(p >= 0) for p in place.tolist()] == [x in known for x in asked.tolist()]
        hit = np.flatnonzero(place >= 0)
        assert values[place[hit]].tolist() == asked[hit].tolist()


def test_trie_matches_a_dictionary():
    rng = np.random.default_rng(2)
    known = {(int(c), int(w)): int(v) for c, w, v in zip(rng.integers(0, (1 << 64) - 1, 40, dtype=np.uint64).repeat(20), rng.integers(0, 1 << 40, 800), rng.integers(1, 99, 800), strict=True)}
    keys, contexts = sorted(known), sorted({c for c, _ in known})
    number = {c: k for k, c in enumerate(contexts)}
    totals = [sum(v for (c, _), v in known.items() if c == x) for x in contexts]
    trie = eliasfano.Trie(np.array(contexts, np.uint64), np.array(totals), np.array([number[c] for c, _ in keys]), np.array([w for _, w in keys], np.uint64), np.array([known[k] for k in keys]))
    place, codes = trie.find(np.array([*contexts, 5], np.uint64))
    assert place.tolist() == [*range(len(contexts)), -1] and np.allclose(eliasfano.restored(codes), [*totals, 0], rtol=3e-4)
    asked = keys[::3] + [(c, w + 1) for c, w in keys[::5]] + [(c, 0) for c in contexts] + [(5, 5)]
    got = trie.lookup(trie.find(np.array([c for c, _ in asked], np.uint64))[0], np.array([w for _, w in asked], np.uint64))
    assert np.allclose(eliasfano.restored(got), [known.get(k, 0) for k in asked], rtol=3e-4)
    empty = eliasfano.Trie(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    place, codes = empty.find(np.array([1], np.uint64))
    assert place.tolist() == [-1] and codes.tolist() == [0] and empty.lookup(place, np.array([1], np.uint64)).tolist() == [0]


def brute_scores(rows, k2=ngram_lm.K2, k3=ngram_lm.K3):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    texts = [(i, [*split(t), "</s>"]) for i, t in rows]
    one, two, three, before = Counter(), Counter(), Counter(), Counter()
    for w in (w for i, w in texts if not held(i)):
        one.update(w)
        padded = ["<s>", "<s>", *w]
        for a, b, c in zip(padded, padded[1:], w, strict=False):
            two[b, c] += 1
            three[a, b, c] += 1
            before[b] += 1
    n, v = sum(one.values()), len(one)
    out = []
    for i, w in texts:
        base = sum(math.log10((one[x] + 1) / (n + v + 1)) for x in w)
        padded, score = ["<s>", "<s>", *w], 0.0
        for k, (a, b, c) in enumerate(zip(padded, padded[1:], w, strict=False)):
            p = (two[b, c] + k2 * (one[c] + 1) / (n + v + 1)) / (before[b] + k2)
            if k:
                p = (three[a, b, c] + k3 * p) / (two[a, b] + k3)
            score += math.log10(p)
        out.append((i, held(i), len(w), sum(one[x] > 0 for x in w), n, base, score))
    return out


@pytest.mark.parametrize("chunk", [2_500_000, 200])
def test_scores_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_lm, "CHUNK_TOKENS", chunk)
    monkeypatch.setattr(ngram_lm, "TEXTS_AT_ONCE", 7)
    rows = near_copies(8, docs=15, copies=4) + [(900, None), (901, ""), (None, "w1 w2"), (902, "A a"), (902, "A a")]
    got = ngram_lm.scores(frame(spark, rows).repartition(2)).collect()
    have = sorted((str(r.doc_id), not r.train, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = sorted((str(i), *rest) for i, *rest in brute_scores(rows))
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5] for x in have], [x[5] for x in want], rtol=1e-9)
    assert np.allclose([x[6] for x in have], [x[6] for x in want], rtol=1e-3)
    assert ngram_lm.scores(frame(spark, rows).limit(0)).count() == 0
    # nothing to learn from
    alone = ngram_lm.scores(frame(spark, [(i, "a b") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2])).collect()
    assert alone and all(r.train_tokens == 0 and r.score == r.base_score == 0 for r in alone)


def test_leaves_of_markup():
    page = "<body><nav><a href=x>Me&amp;nu</a></nav><article><h1>A\n <b>b</b>c</h1><p>one<br>two<p class='X-y'>three <!-- no -->3<script>if (a < b) x('<p>')</script></article>&copy; 5 < 6"
    got = [(path[-1], text, round(linked, 2)) for path, text, linked in html.leaves(page)]
    assert got == [("nav", "Me&nu", 1.0), ("h1", "A bc", 0.0), ("p", "one two", 0.0), ("p class=x class=y", "three 3", 0.0), ("body", "© 5 < 6", 0.0)]
    assert html.leaves("") == [] and html.leaves("<p><") == [(("p",), "<", 0.0)]


def test_gradients_match_differences():
    rng = np.random.default_rng(5)
    model = html.Labeller()
    x, mask = rng.normal(size=(4, 3, html.INPUT)), np.array([[1, 1, 1], [1, 1, 1], [1, 1, 0], [1, 0, 0]], bool)
    y = rng.integers(0, 2, (4, 3)).astype(float)

    def loss():
        s = model.scores(x, mask)
        return -((y * np.log(s) + (1 - y) * np.log(1 - s)) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name, values in model.p.items():
        at = tuple(rng.integers(0, n) for n in values.shape)
        old = values[at]
        values[at] = old + 1e-5
        up = loss()
        values[at] = old - 1e-5
        down = loss()
        values[at] = old
        assert abs((up - down) / 2e-5 - grads[name][at]) < 1e-6


def test_extraction(spark):
    pages = table(spark, "/root/testdata/sf0.01", "pages")
    rows = {r.page_id: r for r in html.extract(pages).collect()}
    good = 0
    for page in pages.collect():
        want = " ".join(text for path, text, _ in html.leaves(page.html) if any(e.split()[0] == "article" for e in path))
        good += rows[page.page_id].text == want
        assert rows[page.page_id].n_chars == len(rows[page.page_id].text)
    assert len(rows) == pages.count() and good >= 0.98 * len(rows)


def test_labels_of_held_out_pages():
    rng, right, total = random.Random(77), 0, 0
    for _ in range(150):
        found, y = html.labelled_page(rng)
        right += int((html.trained().label([found])[0] == (y > 0)).sum())
        total += len(y)
    assert right >= 0.97 * total


def test_odd_pages(spark):
    rows = [(1, "u", None, "t"), (2, None, "", "t"), (3, "u", "no tags at all", "t"), (4, "u", "<article><p>" + "word " * 50_000, "t"), (4, "u", "<div>" * 2000, "t")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted(r.page_id for r in got) == [1, 2, 3, 4, 4]
    assert {r.page_id: r.text for r in got if r.page_id < 4} == {1: "", 2: "", 3: "no tags at all"}


def test_unseen_elements_have_no_text():
    page = "<main><p>One.</p><noscript>Enable it</noscript><template><p>hidden</p></template><svg><text>s</text></svg><select><option>o</select><textarea>t</textarea><p>Two &amp; more.</p></main>"
    assert [x[1] for x in html.leaves(page)] == ["One.", "Two & more."]


def brute_pipeline(docs, bench):
    """(doc_id, text) that reach the last stage."""
    profiles = {}
    for lang in sorted({d.lang for d in docs if d.lang}):
        counts = Counter(g for d in docs if d.lang == lang for g in language.grams(d.text or "").tolist())
        profiles[lang] = {g: k for k, (g, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE])}
    kept = []
    for d in docs:
        own = [g for g, _ in sorted(Counter(language.grams(d.text or "").tolist()).items(), key=lambda x: (-x[1], x[0]))[: language.OWN]]
        if own and any(g in p for p in profiles.values() for g in own):
            kept.append((d.doc_id, d.text))
    gone = brute_word_lines(kept)
    kept = [(i, "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(i, []))) for i, t in kept]
    kept = [(i, t) for i, t in kept if t.strip(" ") or i not in gone]
    label = brute_components(kept)
    kept = [(i, t) for i, t in kept if label[i][1] == i]
    plain = lambda t: "".join(c.lower() if c.isalnum() and c < "\x80" else c if c > "\x7f" else " " for c in t or "").split()
    items = [plain(b.text) for b in bench]

    def leaks(text):
        w = plain(text)
        seeds = {tuple(w[k : k + 5]) for k in range(len(w))}
        near = [i for i in items if any(tuple(i[k : k + 5]) in seeds for k in range(len(i) - 4))]
        return any(sum(n for _, _, n in brute_tiles(i, w, 5)) >= decontaminate.COVERAGE * len(i) for i in near)

    return {(i, t) for i, t in kept if not leaks(t)}


def test_pipeline_matches_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = table(spark, sf, "documents").collect(), table(spark, sf, "benchmark").collect()
    got = corpus_pipeline.run(spark, sf)
    rows = got.collect()
    assert {(r.doc_id, r.text) for r in rows} == brute_pipeline(docs, bench)
    assert all(r.n_chars == len(r.text) for r in rows)
    assert len({(r.mix_slot, r.mix_row) for r in rows}) == len(rows)
    assert set(table(spark, sf, "documents").columns) < set(got.columns)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard", "decontamination", "source_mixing"]
    assert mixing.target_weights()["src0"] == 1

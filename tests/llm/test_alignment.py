"""Cross-tokenizer alignment against a plain loop over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quarry.llm import alignment
from quarry.llm.common import table

ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  blanks  "), (5, "tab\t and\n  lines \n x\r\n\r\n  y"), (6, "▁ not given back"), (7, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (8, "naïve Straße \U0001f600\U0001f468‍\U0001f469 漢字 かな"), (9, "x" * 5000), (10, "word " * 4000), (10, "again the same id"), (None, "without an id"),
    (11, "a\x1c b\x85 c  d　e \x00 f"), (12, "it's we'll 12 345 !? ..."), (13, "a "), (14, " a"), (15, "\n"), (16, "é ﬁ Å"),
]


def plain(rows):
    """Whole texts, ends as sets of offsets, links as a counter."""
    a = Tokenizer.from_file(f"{alignment.FOLDER}/{alignment.NAME_A}")
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=f"{alignment.FOLDER}/{alignment.NAME_B}")
    char = alignment._byte_of_char()
    bytes_a = {i: bytes(char[c] for c in t) for t, i in a.get_vocab(with_added_tokens=False).items() if i != 50256}
    bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(map(b.id_to_piece, range(b.get_piece_size())))]
    out, links = [], Counter()
    for doc_id, text in rows:
        x, y = ([], []) if not text else (a.encode(f" {text}", add_special_tokens=False).ids, b.encode(text))
        raw = f" {text}".encode()
        if not text or b"".join(bytes_a[i] for i in x) != raw or b"".join(bytes_b[i] for i in y) != raw:
            out.append((doc_id, 0, 0, [], [], ""))
            continue
        groups, own, i, j, at_a, at_b = [], [], 0, 0, 0, 0
        now_a, now_b = [], []
        while i < len(x) or j < len(y):
            if at_a <= at_b:
                now_a.append(x[i])
                at_a += len(bytes_a[x[i]])
                i += 1
            else:
                now_b.append(y[j])
                at_b += len(bytes_b[y[j]])
                j += 1
            if at_a == at_b:
                groups.append(f"{','.join(map(str, now_a))}|{','.join(map(str, now_b))}")
                own.append((now_a[-1], now_b[-1]))
                now_a, now_b = [], []
        links.update(own)
        out.append((doc_id, len(x), len(y), groups, own, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    most = defaultdict(int)
    for (_, k), n in links.items():
        most[k] = max(most[k], n)
    return [(d, n, m, len(g), len(o), sum(links[p] == most[p[1]] for p in o), sum(links[p] for p in o), s) for d, n, m, g, o, s in out]


def test_labels_and_groups():
    found = alignment.labels(np.array([2, 3, 6]), np.array([3, 4, 6]), 6)
    assert found.tolist() == [0, 1, 3, 2, 0, 3]
    ends, to_a, to_b = alignment.groups(found)
    assert (ends.tolist(), to_a.tolist(), to_b.tolist()) == ([3, 6], [2, 3], [1, 3])


@pytest.mark.parametrize("limits", [(1 << 20, 1 << 22), (50, 200)])
def test_odd_texts_in_chunks_of_any_size(spark, monkeypatch, limits):
    monkeypatch.setattr(alignment, "CHUNK_WORDS", limits[0])
    monkeypatch.setattr(alignment, "KEPT_TOKENS", limits[1])
    monkeypatch.setattr(alignment, "ROWS", 3)
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in ODD], "doc_id long, text string, chunk string, a int, n long").repartition(3)
    got = alignment.align(docs)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, plain(ODD)))


def test_query_on_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in table(spark, folder, "documents").collect()]
    got = alignment.op13_tokenizer_alignment(spark, folder)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_whole_texts_and_words_agree(spark):
    both = alignment.Tokenizers(*alignment.files(alignment.FOLDER))
    assert both.by_words
    rng = random.Random(5)
    mixed = ["".join(rng.choice("   \t\n\r\x1c\xa0\u3000aabcé!1'.") for _ in range(rng.randint(1, 14))) for _ in range(4000)]
    for text in [t for _, t in ODD] + mixed:
        if text:
            words = both.words(text)
            assert " " + " ".join(words) == f" {text}"
            parts = list(both.encode(words))
            whole = next(both.encode([text]))
            assert ([i for a, _ in parts for i in a], [i for _, b in parts for i in b]) == whole


def test_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_task_holds_many_chunks_at_once(spark, monkeypatch):
    seen, spill = [], alignment.spill
    monkeypatch.setattr(alignment, "CHUNK_WORDS", 5)
    monkeypatch.setattr(alignment, "ROWS", 50)
    monkeypatch.setattr(alignment, "spill", lambda *a: seen.append(spill(*a)) or seen[-1])
    docs = spark.createDataFrame([(k, f"some words of text {k}") for k in range(4000)], "doc_id long, text string").repartition(1)
    got = alignment.align(docs)
    assert got.count() == 4000 and got.filter("n_links = 0").count() == 0
    stored = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in seen[0].inputFiles()]
    most = max(m.row_group(k).num_rows for m in stored for k in range(m.num_row_groups))
    assert seen[0].count() > 10 * alignment.GROUPED and most <= alignment.GROUPED
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "MapInArrow" not in plan

"""Chunks by format, vectors of text, packing, records, evaluation and search requests."""

import json
import math
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quarry.functions import expressions as X
from quarry.functions import text
from quarry.operators import chunking, embedding, evaluation, retrieval, search
from quarry.plans import registry
from quarry.plans.fixtures import PDF, SLIDES
from quarry.sources import files

SF = "/root/testdata/sf0.001"


def plain_chunks(body, size, overlap):
    """The chunks by looking at every position on its own."""
    body = body.replace("\r\n", "\n").replace("\r", "\n").strip()
    kinds = (r"\n\s*\n$", r"\n$", r"[.!?。！？][\"'”’）)]*\s*$", r"\s$")
    out, start = [], 0
    while start < len(body):
        end = limit = min(start + size, len(body))
        if limit < len(body):
            low = max(start + 1, limit - 160)
            for kind in kinds:
                ends = [k for k in range(low + 1, limit + 1) if re.search(kind, body[low:k])]
                # a boundary reaches as far as it can: one that goes on is not over
                if ends:
                    end = ends[-1]
                    break
        if body[start:end].strip():
            out.append(body[start:end].strip())
        if end >= len(body):
            return out
        after = end
        if overlap:
            after = max(start + 1, end - overlap)
            blanks = [k for k in range(max(start + 1, after - 40), after) if body[k].isspace()]
            after = blanks[-1] + 1 if blanks else after
        start = after
    return out


def test_chunks_end_at_their_best_boundary():
    assert chunking.pieces("そうです。」" * 40, 50, 0)[0].endswith("。")  # a corner bracket closes no sentence
    assert chunking.pieces("a b.\n \n" + "x" * 30, 20, 0)[0] == "a b."
    assert chunking.pieces("one two) three.) four" + "x" * 30, 21, 5)[0] == "one two) three.)"
    assert "".join(chunking.pieces("y" * 95, 30, 0)) == "y" * 95


def test_chunks_against_a_plain_loop(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bodies = {r.doc_id: r.text or "" for r in docs.collect()}
    got = {}
    for r in registry.QUERIES["chunk_documents"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append(r.content)
    assert got == {k: c for k, b in bodies.items() if (c := plain_chunks(b, 900, 100))}


def test_chunks_by_format(spark):
    section = "text string, page int, slide int, title string"
    rows = [("a", PDF, [("x. " * 400, 1, None, ""), ("", 2, None, "t"), ("end", 3, None, "t")]), ("b", SLIDES, [("y. " * 400, None, 1, "T")]), ("c", "other", None), ("d", None, [])]
    got = chunking.chunk_sections(spark.createDataFrame(rows, f"document_id string, mime string, sections array<struct<{section.replace(' ', ':').replace(',:', ',')}>>")).collect()
    a = [r for r in got if r.document_id == "a"]
    assert [r.chunk_index for r in a] == list(range(len(a))) and [r.content for r in a[:-1]] == plain_chunks("x. " * 400, 900, 120)
    assert (a[-1].content, a[-1].page, a[-1].section_title) == ("end", 3, "t") and a[0].section_title is None and a[0].slide is None
    assert [(r.slide, r.section_title) for r in got if r.document_id == "b"] == [(1, "T")] * len(plain_chunks("y. " * 400, 1500, 100))
    assert {r.document_id for r in got} == {"a", "b"}


def test_chunk_by_format_query(spark):
    docs = {f"f{r.doc_id:07d}": r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = registry.QUERIES["chunk_by_format"](spark, SF).collect()
    for name, r in docs.items():
        k = r.doc_id
        size = (1500, 100) if k % 17 and k % 8 in (1, 3) else (900, 120) if k % 17 and k % 2 == 0 else (900, 100)
        want = [(n, c) for n, part in enumerate((r.text or "").split("\n\n"), 1) for c in plain_chunks(part, *size)]
        assert sorted((x.chunk_index, x.page, x.content) for x in got if x.document_id == name) == [(i, n, c) for i, (n, c) in enumerate(want)]


def test_xml(spark):
    assert text.decode_xml("&lt;&amp;#65;&#x42;&nbsp;&apos;&#1114112;&amp;lt;") == "<AB&nbsp;'&#1114112;&lt;"
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {(r.page_id, r.pos): r.text for r in registry.QUERIES["xml_decode"](spark, SF).collect()}
    assert got == {(k, i): text.decode_xml(p) for k, h in pages.items() for i, p in enumerate(re.findall(r"<p(?:\s[^>]*)?>(.*?)</p>", h or "", re.S))}


def test_text_functions(spark):
    rows = spark.createDataFrame([("ｓeminar.PDF", "a \r\n\n\n\nb ", "éé"), ("seminar_final.pptx", None, None), (".hidden", "", ""), (None, " ", "a")], "name string, body string, cut string")
    got = rows.select(text.basename(F.col("name")), text.tidy(F.col("body")), text.truncated_utf8(F.col("cut"), 3)).collect()
    assert [tuple(r) for r in got] == [("seminar", "a\n\nb", "é"), ("seminar_final", None, None), (".hidden", "", ""), (None, "", "a")]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (3 * 1024**3 // 2,)], "n long")
    assert [r[0] for r in sizes.select(X.bytes_label(F.col("n"))).collect()] == ["0 B", "1023 B", "1.5 KiB", "1.50 GiB"]


def plain_vector(body, dims):
    def fnv(s):
        h = 2166136261
        for i in range(0, len(raw := s.encode("utf-16-le")), 2):
            h = ((h ^ (raw[i] | raw[i + 1] << 8)) * 16777619) % 2**32
        return h

    body = unicodedata.normalize("NFKC", body).lower().strip()
    words = re.findall(r"[^\W_]+", body)
    flat = re.sub(r"\s+", " ", body)
    told = [("word:" + w, 2) for w in words] + [(f"pair:{a}_{b}", 1.5) for a, b in zip(words, words[1:], strict=False)]
    told += [(f"char-{n}:{flat[i:i + n]}", w) for n, w in ((2, 0.55), (3, 0.35)) for i in range(len(flat) - n + 1)]
    out = [0.0] * dims
    for feature, weight in set(told):
        out[fnv(feature) % dims] += (1 if fnv(feature + ":sign") % 2 == 0 else -1) * weight * (1 + math.log(told.count((feature, weight))))
    size = math.sqrt(sum(x * x for x in out))
    return [x / size for x in out] if size else out


def test_hashed_vectors(spark):
    bodies = ["Ein Fluß, ein  Fluss! ９", "a", "", None, "😀 wörter_und 漢字 漢字"]
    got = embedding.embed(spark.createDataFrame([(b,) for b in bodies], "text string"), dimensions=16).collect()
    for r in got:
        assert r.embedding == pytest.approx(plain_vector(r.text or "", 16))
    with pytest.raises(ValueError):
        embedding.embed(spark.createDataFrame([("a",)], "text string"), dimensions=4)


def test_packing(spark):
    rows = spark.createDataFrame([(g, i, "x") for g in "ab" for i in range(7)] + [("c", 0, None)], "g string, i int, t string")
    got = {(r.g, r.i): r.batch for r in embedding.packed(rows, "g", "i", "t", tokens=108).collect()}
    assert got == {(g, i): i // 6 for g in "ab" for i in range(7)} | {("c", 0): 0} and rows.columns == ["g", "i", "t"]
    assert max(r.batch for r in embedding.packed(rows, "g", "i", "t", items=2).collect()) == 3
    with pytest.raises(Exception, match="beyond"):
        embedding.packed(rows, "g", "i", "t", tokens=16).collect()


def test_records(spark):
    def decode(**record):
        frame = spark.createDataFrame([(json.dumps({"id": "1", "documentId": "d", "documentName": "n", "chunkIndex": "7", "content": "c"} | record),)], "json string")
        return files.decode_entities(frame).first()

    r = decode(page="3", slide="x", url="", embedding=[1.5])
    assert (r.chunk_index, r.page, r.slide, r.url, r.embedding) == (7, 3, None, None, [1.5]) and decode().embedding == []
    for broken in ({"id": ""}, {"chunkIndex": "z"}, {"content": None}, {"chunkIndex": str(2**53)}):
        with pytest.raises(Exception, match="mandatory"):
            decode(**broken)
    chunk = {"id": "1", "documentId": "d", "chunkIndex": 0, "content": "c", "embedding": [1.0]}
    index = lambda **x: spark.createDataFrame([(json.dumps({"version": 1, "embeddingProviderId": "p", "embeddingDimensions": 1, "chunks": [chunk]} | x),)], "json string")
    assert files.parse_indexes(index()).first().embedding == [1.0] and files.parse_indexes(index(chunks=[])).count() == 0
    for broken in ({"version": 2}, {"embeddingDimensions": 2}, {"chunks": [{"id": "1"}]}):
        with pytest.raises(Exception, match="not a valid index"):
            files.parse_indexes(index(**broken)).collect()


def dataset(**changes):
    case = {"id": "q", "query": "x", "category": "c", "judgments": [{"documentName": "a", "relevance": 3}]}
    return {"version": 1, "description": "d", "relevantThreshold": 2, "relevanceScale": {"3": "all"}, "cases": [case | changes.pop("case", {})]} | changes


def test_dataset_checks():
    assert evaluation.checked_dataset(dataset()) == dataset()
    twice = [{"documentName": "é", "relevance": 1}, {"documentName": "é", "relevance": 1}]
    wrong = [{"version": 0}, {"version": True}, {"description": " "}, {"relevantThreshold": 4}, {"relevanceScale": {"1": 2}}, {"cases": []}, {"cases": dataset()["cases"] * 2}]
    wrong += [{"case": c} for c in ({"query": ""}, {"judgments": None}, {"judgments": twice}, {"judgments": [{"documentName": "a", "relevance": 1.5}]}, {"noAnswer": True}, {"note": 3})]
    for change in wrong:
        with pytest.raises(ValueError):
            evaluation.checked_dataset(dataset(**change))


def test_evaluation(spark):
    cases = spark.createDataFrame([("a", False), ("b", True), ("c", False)], "case_id string, no_answer boolean")
    judged = spark.createDataFrame([("a", "x", 3), ("a", "y", 2), ("a", "z", 1)], "case_id string, document string, grade int")
    results = spark.createDataFrame([("a", "x", 0.9, 1), ("a", "?", 0.8, 2), ("a", "y", 0.7, 3), ("a", "z", 0.6, 4), ("b", "x", 0.5, 1)], "case_id string, document string, score double, rank int")
    found = evaluation.evaluate(cases, judged, results, 3)
    got = {r.case_id: r for r in found.collect()}
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.hit, a.mrr, a.unjudged, a.judged_relevant, a.top_score) == (1, 1, 1, 2, 0.9) and 0.90 < a.ndcg < 0.91
    assert (b.hit, b.mrr, b.ndcg, b.top_score, b.unjudged) == (None, None, None, 0.5, 1) and (c.hit, c.mrr, c.ndcg, c.top_score) == (0, 0, 0, None)
    s = evaluation.summary(found).first()
    assert (s.cases, s.answered, s.no_answer, s.hit, s.mean_silent_score) == (3, 2, 1, 0.5, 0.5)


def test_containing(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "so one two\tthree four five six seven"), (2, "one two"), (3, None), (4, ""), (5, "xone two three four five sixx")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two\tthree four five six seven"), (2, "two"), (3, None), (4, "one two three"), (5, "ne two three four five six")], "item_id long, text string")
    got = sorted(tuple(r) for r in evaluation.containing(docs, items).collect())
    assert got == [(1, 1), (2, 1), (2, 2), (2, 5), (4, 5), (5, 5)]
    monkeypatch.setattr(evaluation, "SHORT_ITEMS", 1)
    assert sorted(tuple(r) for r in evaluation.containing(docs, items).collect()) == got
    assert evaluation.containing(docs, items.limit(0)).count() == 0


def test_requests_and_cache():
    assert search.Request.of({"query": " x ", "source": "web"}) == search.Request("x", "web", 5)
    for wrong in (None, {}, {"query": " ", "source": "web"}, {"query": "x" * 2001, "source": "web"}, {"query": "x", "source": "?"}, {"query": "x", "source": "web", "limit": 21}, {"query": "x", "source": "web", "limit": True}):
        with pytest.raises(search.InvalidRequest):
            search.Request.of(wrong)
    now, asked = [0.0], []

    class Counting(search.LocalProvider):
        def embed_query(self, query):
            asked.append(query)
            return super().embed_query(query)

    cached = search.CachedProvider(Counting(16), seconds=10, entries=2, clock=lambda: now[0])
    cached.embed_query("a  b").append(1)
    assert len(cached.embed_query(" a b ")) == 16 and len(asked) == 1
    now[0] = 10
    cached.embed_query("a b")
    for q in ("c", "a b", "d", "a b", "c"):
        cached.embed_query(q)
    assert asked == ["a  b", "a b", "c", "d", "c"]


def test_search(spark):
    bodies = [("a", 0, "red apples"), ("b", 1, "blue sky"), ("a", 2, "green apples"), ("c", 3, "apples and pears")]
    chunks = embedding.embed(spark.createDataFrame(bodies, "document_id string, ordinal long, content string"), "content", 64)
    provider, request = search.LocalProvider(64), search.Request("green apples", limit=2)
    plain = search.search(chunks, request, provider).collect()
    assert plain[0].document_id == "a" and plain[0].ordinal == 2 and plain[0].score == pytest.approx(1) and plain[0].score_type == "cosine" and len(plain) == 2
    again = search.search(chunks, request, provider, lambda q, d: d.select("document_id", F.when(F.col("document_id") == "b", 1.0).otherwise(0.5).alias("relevance"))).collect()
    assert [r.document_id for r in again] == ["b", "a"] and again[0].score_type == "reranker" and again[0].retrieval_score < 1
    failing = search.search(chunks, request, provider, lambda q, d: 1 / 0).collect()
    assert [r.document_id for r in failing] == [r.document_id for r in plain] and failing[0].score_type == "cosine"
    linked = search.search(chunks, request, provider, folders=spark.createDataFrame([("a", "x y"), ("b", "")], "document_id string, folder string")).collect()
    assert {r.document_id: r.folder_url for r in linked}["a"].endswith("/x%20y") and len(linked) == 2
    sparse = spark.createDataFrame([(1, 1), (3, 2)], "ordinal long, rank int")
    mixed = search.search(chunks, request, provider, sparse=lambda q, n: sparse).collect()
    assert mixed[0].score_type == "rrf" and mixed[0].score == pytest.approx(max(r.score for r in mixed))
    with pytest.raises(search.InvalidRequest):
        search.search(chunks, request, provider, lambda q, d: d, pool=51)


def test_hybrid_lists_grow_together(spark):
    chunks = spark.createDataFrame([("a" if k < 120 else f"d{k}", k, [1.0]) for k in range(600)], "document_id string, ordinal long, embedding array<double>")
    dense = chunks.select("ordinal", (F.col("ordinal") + 1).cast("int").alias("rank"))
    sparse = chunks.filter("ordinal < 300").select("ordinal", (300 - F.col("ordinal")).cast("int").alias("rank"))

    def plain(level):
        score = {}
        for k in range(600):
            for rank in [k + 1] + ([300 - k] if k < 300 else []):
                if rank <= level:
                    score[k] = score.get(k, 0) + 1 / (60 + rank)
        return dict(sorted(score.items(), key=lambda x: (-x[1], x[0]))[:level])

    for pool, level in ((5, 100), (150, 500)):
        got = {r.ordinal: r.score for r in retrieval.hybrid(chunks, dense, sparse, pool).collect()}
        assert got == pytest.approx(plain(level))
    assert retrieval.hybrid(chunks.limit(0), dense, sparse.limit(0), 5).count() == 0


def test_rerank_text(spark):
    row = spark.createDataFrame([("n", "", 2, None, "body", ["p", "q", "r"])], "name string, section string, page int, slide int, content string, related array<string>")
    got = row.select(search.rerank_text(*[F.col(c) for c in row.columns])).first()[0]
    assert got == "文書名: n\nページ: 2\nbody\n関連箇所1:\np\n関連箇所2:\nq"

"""A search request from its text to ranked documents, with providers that can be replaced."""

from __future__ import annotations

import logging
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.expressions import folder_url
from quarry.operators import retrieval
from quarry.operators.embedding import hashed

log = logging.getLogger(__name__)
#: Limits of a request: its text, its results and the documents that are ranked again.
LONGEST_QUERY, DEFAULT, MOST_RESULTS, POOL, MOST_POOL = 2000, 5, 20, 20, 50
SOURCES = ("web", "slack")


class InvalidRequest(ValueError):
    """A request that no search answers."""


@dataclass(frozen=True)
class Request:
    query: str
    source: str = "web"
    limit: int = DEFAULT

    @classmethod
    def of(cls, body: object) -> Request:
        """A checked request; its query is trimmed."""
        if not isinstance(body, dict):
            raise InvalidRequest("a request is an object")
        query, source, limit = body.get("query"), body.get("source"), body.get("limit", DEFAULT)
        if not isinstance(query, str) or not query.strip() or len(query) > LONGEST_QUERY:
            raise InvalidRequest(f"a query has 1 to {LONGEST_QUERY} characters")
        if source not in SOURCES:
            raise InvalidRequest(f"a source is one of {SOURCES}")
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= MOST_RESULTS:
            raise InvalidRequest(f"a limit is 1 to {MOST_RESULTS}")
        return cls(query.strip(), source, limit)


class Provider(Protocol):
    """Gives the vector of a query."""

    id: str
    dimensions: int

    def embed_query(self, text: str) -> list[float]: ...


class LocalProvider:
    """Hashed vectors, without any service."""

    id = "local-hashing-v2"

    def __init__(self, dimensions: int = 384):
        self.dimensions = dimensions

    def embed_query(self, text: str) -> list[float]:
        return hashed(text, self.dimensions).tolist()


class CachedProvider:
    """Vectors of queries, kept for ``seconds``, the least recently used going first; queries
    that differ in white space alone are one."""

    def __init__(self, provider: Provider, seconds: float = 900, entries: int = 500, clock: Callable[[], float] = time.monotonic):
        self.provider, self.seconds, self.entries, self.clock = provider, seconds, entries, clock
        self.id, self.dimensions = provider.id, provider.dimensions
        self._held: OrderedDict[str, tuple[float, list[float]]] = OrderedDict()

    def embed_query(self, text: str) -> list[float]:
        key = " ".join(text.split())
        found = self._held.pop(key, None)
        if found is None or found[0] <= self.clock():
            found = self.clock() + self.seconds, self.provider.embed_query(text)
        self._held[key] = found
        while len(self._held) > self.entries:
            self._held.popitem(last=False)
        return list(found[1])


def rerank_text(name: Column, section: Column, page: Column, slide: Column, content: Column, related: Column) -> Column:
    """What a re-ranker reads of a result: its labelled place, its text, two related texts."""
    # The labels.
    labels = (("文書名: ", name), ("節: ", F.nullif(section, F.lit(""))), ("ページ: ", F.nullif(page, F.lit(0))), ("スライド: ", F.nullif(slide, F.lit(0))))
    others = F.transform(F.slice(related, 1, 2), lambda c, i: F.concat(F.lit("関連箇所"), (i + 1).cast("string"), F.lit(":\n"), c))
    return F.concat_ws("\n", *[F.concat(F.lit(text), value.cast("string")) for text, value in labels], content, others)


def search(
    chunks: DataFrame,
    request: Request,
    provider: Provider,
    relevance: Callable[[str, DataFrame], DataFrame] | None = None,
    pool: int = POOL,
    sparse: Callable[[str, int], DataFrame] | None = None,
    folders: DataFrame | None = None,
) -> DataFrame:
    """Documents for a request over chunks (document_id, ordinal, embedding, ...).

    Candidates are the chunks most like the query's vector, or with ``sparse`` (a list of
    ordinal and rank for a text and a length) those of both lists by reciprocal ranks; their
    number grows until they hold enough documents. ``relevance`` scores the best ``pool``
    documents anew (document_id, relevance); if it fails, the order of retrieval stays.
    ``folders`` (document_id, folder) gives links. At most 500 chunks are beyond the top-k.
    """
    wanted = request.limit
    if relevance:
        if not request.limit <= pool <= MOST_POOL:
            raise InvalidRequest(f"a pool has {request.limit} to {MOST_POOL} documents")
        wanted = pool
    order = Window.orderBy(F.desc("score"), "ordinal")  # MOST rows at most
    top = retrieval.dense_topk(chunks, provider.embed_query(request.query), retrieval.MOST)
    ranked = top.withColumn("rank", F.row_number().over(order))
    if sparse:
        matches = retrieval.hybrid(chunks, ranked, sparse(request.query, retrieval.MOST), wanted)
    else:
        matches = retrieval.grown(ranked, wanted)
    found = retrieval.grouped(matches, wanted).withColumn("score_type", F.lit("rrf" if sparse else "cosine"))
    results = None
    if relevance:
        try:
            scored = relevance(request.query, found).select("document_id", "relevance").limit(pool).collect()
            again = chunks.sparkSession.createDataFrame(scored, "document_id string, relevance double")
            joined = found.join(F.broadcast(again), "document_id").withColumnRenamed("score", "retrieval_score")
            results = joined.withColumn("score_type", F.lit("reranker")).withColumnRenamed("relevance", "score").orderBy(F.desc("score"), F.desc("retrieval_score"), "document_id").limit(request.limit)
        except Exception:  # any failure of another's code keeps the order of retrieval
            log.exception("re-ranking failed; the order of retrieval stays")
    if results is None:
        results = found.orderBy(F.desc("score"), "ordinal").limit(request.limit).withColumn("retrieval_score", F.col("score"))
    if folders is not None:
        links = folders.filter("folder <> ''").select("document_id", folder_url("https://drive.google.com/drive/folders/", F.col("folder")).alias("folder_url"))
        wanted_links = links.join(F.broadcast(results.select("document_id")), "document_id", "left_semi")
        results = results.join(wanted_links, "document_id", "left")
    return results

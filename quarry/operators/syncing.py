"""A synchronisation that acts: what is new or changed in a listing is fetched, cut, embedded and
committed to a ``Store`` together with the state of its files, a wave of files at a time. What is decided
on files and chunks is decided on their keys; contents go from what was fetched to the store.

A wave is one version of the store: its new vectors, the chunks that its documents no longer have,
the chunks of documents that are to be cleared, and the state of its files; the first one also clears
duplicates and files that are gone. A run that dies leaves
whole waves; the next one finds their files up to date. Chunks whose text and source time are
stored already keep their vectors. Where a quota ends the run, the batches before it are kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.expressions import embedding_input
from quarry.operators.committed import CODEC, Change, Store, Table
from quarry.operators.store import reusable
from quarry.operators.sync import CHECKPOINT, KNOWN_FAILURES, actions
from quarry.session import stored

#: The tables that a synchronised store has.
TABLES = {
    "chunks": Table("id string, document_id string, chunk_index int, content string, section_title string, source_modified_time string, embedding array<float>", "id", "document_id"),
    "documents": Table("id string, modified string, is_indexed boolean, provider string, store string, duplicate_of string, is_active boolean", "id", "id"),
}
#: Files of a wave, unless a run says otherwise.
WAVE = 1_000_000
_COUNTERS = (
    "new", "updated", "skipped", "duplicates", "failed", "removed", "unsupported", "skipped_abusive_files", "skipped_empty_documents", "permission_errors", "export_size_errors",
    "file_not_downloadable_errors", "embedding_quota_exhausted", "deferred", "embedded_chunks", "reused_chunks", "embedding_batch_attempts", "embedding_input_attempts",
)


def running(rows: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row. Ranges of the order are summed apart; what
    lies before a range is a number for each range."""
    dealt = stored(rows.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()), "running")
    totals = dict(dealt.groupBy("range_").agg(F.sum(value)).collect())
    before, at = {}, 0
    for k in sorted(totals):
        before[k] = at
        at += totals[k] or 0
    offset = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("range_")) if before else F.lit(0)
    own = F.sum(value).over(Window.partitionBy("range_").orderBy(*order))
    return dealt.withColumn(out, own + offset).drop("range_")


def cut(fetched: DataFrame) -> DataFrame:
    """(document_id, ordinal, id, chunk_index, content, section_title, source_modified_time) of files that were read."""
    rows = fetched.filter("reason IS NULL").select(F.col("id").alias("document_id"), "ordinal", "modified", F.posexplode("chunks").alias("chunk_index", "c"))
    named = F.concat_ws(":", "document_id", F.col("chunk_index").cast("string"))
    return rows.select("document_id", "ordinal", named.alias("id"), "chunk_index", F.col("c.content").alias("content"), F.col("c.section_title").alias("section_title"), F.col("modified").alias("source_modified_time"))


def batches(chunks: DataFrame, size: int) -> DataFrame:
    """(ordinal, batch, missing): the batches of chunks that have some without a vector."""
    numbered = chunks.select("ordinal", F.floor(F.col("chunk_index") / size).cast("int").alias("batch"), "reused")
    return numbered.groupBy("ordinal", "batch").agg(F.count_if(~F.col("reused")).alias("missing")).filter("missing > 0")


def until_quota(wanted: DataFrame, quota: int | None) -> tuple[int | None, int | None]:
    """The (ordinal, batch) that a quota of inputs does not allow any more; None if all are allowed."""
    if quota is None:
        return None, None
    first = running(wanted, ["ordinal", "batch"], "missing", "so_far").filter(F.col("so_far") > quota).agg(F.min(F.struct("ordinal", "batch")).alias("x")).first()["x"]
    return (first["ordinal"], first["batch"]) if first else (None, None)


def _result(stop: int | None) -> Column:
    late = F.lit(False) if stop is None else F.col("ordinal") > stop
    hit = F.lit(False) if stop is None else F.col("ordinal") == stop
    empty = F.col("many") == 0
    return F.when(late, "late").when(hit, "quota").when(F.col("reason").isNotNull(), F.when(F.col("reason").isin(*KNOWN_FAILURES), F.col("reason")).otherwise("failed")).when(empty, "empty").otherwise("ok")


class Run:
    """One synchronisation of a listing (id, ordinal, base, mime, parents, modified) with a store.

    ``fetch`` makes of files (id, ordinal, mime, modified) a row for each: (id, reason, chunks: a list of
    content and section_title); a reason says why a file could not be read. ``embed`` adds
    ``embedding`` to rows with ``text``. ``quota``: inputs that may be embedded. ``stream`` and
    ``number`` name the run: one that has been committed whole does nothing when it is made again."""

    def __init__(self, store: Store, provider: str, store_id: str, fetch: Callable[[DataFrame], DataFrame], embed: Callable[[DataFrame], DataFrame], batch: int = CHECKPOINT, quota: int | None = None, wave: int = WAVE):
        if not 1 <= batch <= 100:
            raise ValueError("a batch has 1 to 100 chunks")
        self.store, self.provider, self.store_id, self.fetch, self.embed = store, provider, store_id, fetch, embed
        self.batch, self.quota, self.wave = batch, quota, wave

    def _state(self, files: DataFrame, indexed: Column, duplicate_of: Column, active: Column) -> DataFrame:
        return files.select("id", "modified", indexed.alias("is_indexed"), F.lit(self.provider).alias("provider"), F.lit(self.store_id).alias("store"), duplicate_of.cast("string").alias("duplicate_of"), active.alias("is_active"))

    def __call__(self, listing: DataFrame, stream: str | None = None, number: int = 0) -> dict[str, int]:
        """The counters of the run."""
        totals = dict.fromkeys(_COUNTERS, 0)
        if stream is not None and self.store.manifest().streams.get(stream, -1) >= number:
            return totals
        known = self.store.read("documents").filter("is_active")
        acted = actions(listing, known, self.provider, self.store_id)
        files = stored(acted.join(listing.select("id", "ordinal", "mime", "modified"), "id", "left").join(known.select("id", F.col("modified").alias("old_modified")), "id", "left"), "actions")
        for r in files.groupBy("action").count().collect():
            name = {"skip": "skipped", "duplicate": "duplicates"}.get(r["action"], r["action"])
            if name in ("duplicates", "removed", "unsupported", "skipped"):
                totals[name] += r["count"]
        settled = self._settled(files)
        todo = stored(files.filter("action IN ('new', 'updated')").select("id", "ordinal", "mime", "modified", "action"), "todo")
        many, left = todo.count(), self.quota
        waves = max(1, -(-many // self.wave))
        dealt = todo if waves == 1 else stored(todo.repartitionByRange(waves, "ordinal").withColumn("wave", F.spark_partition_id()), "waves")
        for at in range(waves if many else 0):
            part = dealt if waves == 1 else dealt.filter(F.col("wave") == at).drop("wave")
            stop = self._wave(part, left, totals, None if at else settled)
            left = None if left is None else max(0, self.quota - totals["embedded_chunks"])
            if stop is not None:
                late = todo.filter(F.col("ordinal") >= stop)
                totals["deferred"] = late.count()
                # files read before the quota ended are skipped next time; those after it were not looked at
                totals["skipped"] -= files.filter((F.col("action") == "skip") & (F.col("ordinal") > stop)).count()
                self.store.commit({"documents": Change(upserts=self._state(late, F.lit(False), F.lit(None), F.lit(True)))})
                break
        if not many and settled is not None:
            self.store.commit(self._changes(settled))
        if stream is not None:
            self.store.commit({}, stream, number)
        return totals

    def _settled(self, files: DataFrame) -> DataFrame | None:
        """The states of duplicates and of files that are gone: their chunks go."""
        duplicates = self._state(files.filter("action = 'duplicate'"), F.lit(False), F.col("kept_id"), F.lit(True))
        gone = self._state(files.filter("action = 'removed'").withColumn("modified", F.col("old_modified")), F.lit(False), F.lit(None), F.lit(False))
        settled = stored(duplicates.unionByName(gone), "settled")
        return None if settled.isEmpty() else settled

    @staticmethod
    def _changes(settled: DataFrame) -> dict[str, Change]:
        return {"chunks": Change(removed=settled.select(F.col("id").alias("document_id"))), "documents": Change(upserts=settled)}

    def _wave(self, todo: DataFrame, quota: int | None, totals: dict[str, int], settled: DataFrame | None = None) -> int | None:
        """Commits a wave; the ordinal at which a quota ended it."""
        keys = todo.select("id", "ordinal", "modified", "action")
        read_in = keys.join(self.fetch(todo.drop("action")).select("id", "reason", "chunks"), "id", "left").withColumn("reason", F.when(F.col("chunks").isNull() & F.col("reason").isNull(), "missing").otherwise(F.col("reason")))
        fetched = stored(read_in.withColumn("many", F.size(F.coalesce("chunks", F.array()))), "fetched", CODEC)
        wanted = cut(fetched)
        held = stored(reusable(wanted, self.store.read("chunks"), self.store.identity.dimensions).select("document_id", "id"), "reused")
        named = wanted.select("document_id", "ordinal", "id", "chunk_index")
        chunks = stored(named.join(held.withColumn("reused", F.lit(True)), ["document_id", "id"], "left").withColumn("reused", F.coalesce("reused", F.lit(False))), "wanted")
        stop, stop_batch = until_quota(batches(chunks, self.batch), quota)
        results = fetched.select("id", "ordinal", "modified", "action", _result(stop).alias("result"))
        own_batch = F.floor(F.col("chunk_index") / self.batch)
        allowed = F.lit(True) if stop is None else (F.col("ordinal") < stop) | ((F.col("ordinal") == stop) & (own_batch < stop_batch))
        # what is held is small or none as a rule: contents need not travel to meet it then
        missing = wanted.filter(allowed) if held.isEmpty() else wanted.filter(allowed).join(held, ["document_id", "id"], "left_anti")
        told = missing.withColumn("text", embedding_input(F.col("section_title"), F.col("content")))
        new = self.embed(told).select(*[c for c in wanted.columns if c != "ordinal"], "embedding")
        read = results.filter("result = 'ok'")
        clears = results.filter(F.col("result").isin("empty", *KNOWN_FAILURES)).select(F.col("id").alias("document_id"))
        expected = chunks.join(read.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("document_id", "id")
        states = self._state(results.filter("result NOT IN ('late', 'quota')"), F.col("result") == "ok", F.lit(None), F.lit(True))
        if settled is not None:
            clears = clears.unionByName(settled.select(F.col("id").alias("document_id")))
            states = states.unionByName(settled)
        self.store.commit({"chunks": Change(upserts=new, removed=clears, expected=expected), "documents": Change(upserts=states)})
        self._count(results, chunks, allowed, stop, stop_batch, totals)
        return stop

    def _count(self, results: DataFrame, chunks: DataFrame, allowed: Column, stop: int | None, stop_batch: int | None, totals: dict[str, int]) -> None:
        abusive, *others = KNOWN_FAILURES
        found: dict[tuple[str, str], int] = {(r["action"], r["result"]): r["count"] for r in results.groupBy("action", "result").count().collect()}
        by_result: dict[str, int] = {}
        for (action, result), n in found.items():
            by_result[result] = by_result.get(result, 0) + n
            if result == "ok":
                totals[action] += n
        totals["skipped_empty_documents"] += by_result.get("empty", 0)
        for reason in KNOWN_FAILURES:
            totals[KNOWN_FAILURES[reason]] += by_result.get(reason, 0)
        totals["failed"] += sum(by_result.get(x, 0) for x in ("failed", "quota", *others))
        totals["embedding_quota_exhausted"] |= int(stop is not None)
        reached = F.lit(True) if stop is None else F.col("ordinal") <= stop
        held = chunks.agg(F.count_if(~F.col("reused") & allowed).alias("new"), F.count_if(F.col("reused") & reached).alias("reused")).first()
        totals["embedded_chunks"] += held["new"]
        totals["reused_chunks"] += held["reused"]
        tried = F.lit(True) if stop is None else (F.col("ordinal") < stop) | ((F.col("ordinal") == stop) & (F.col("batch") <= stop_batch))
        sent = batches(chunks, self.batch).filter(tried).agg(F.count("*").alias("n"), F.coalesce(F.sum("missing"), F.lit(0)).alias("m")).first()
        totals["embedding_batch_attempts"] += sent["n"]
        totals["embedding_input_attempts"] += sent["m"]

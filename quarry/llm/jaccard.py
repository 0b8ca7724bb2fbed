"""N-gram Jaccard join: documents whose sets of five-word shingles link, and their components.

Documents with one set are one record (their links are certain); records that may link are
found and brought together by ``setjoin``. There each record is a T-occurrence query against
the inverted lists of its task by DivideSkip: with the least overlap T that any partner
needs, the L longest lists are set aside, the short ones are merged, records with T - L
occurrences stay and are probed for the tokens of the long lists: by binary search, or, where
that costs more, by a merge of these lists too. The intersections are exact. All links between
different sets are found; each task hands on the number of linked documents of each of its
records and a forest of the links, never the pairs. ``keep_first`` needs components only and
passes over records already connected.

A null or blank text has no words, an empty set, and links with nothing. A text of fewer
than five words is one shingle. Ids are taken to be unique; rows that share one each have the
component of their own text. A row with a null id has a null component. Repeated rows stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import bitmap, in_bitmap, lean, mix, slices, small_batches, spill, table
from quarry.llm.components import components, forest
from quarry.llm.setjoin import PERCENT, candidates, first_number, met, prefix_size, signature, spare, tasks
from quarry.llm.tokens import shingle_sets

WORDS = 5
#: DivideSkip's weight of a probe against a merge step.
MU = 0.0085


def linked(sets: list[np.ndarray], apart: np.ndarray | None = None, every: bool = True) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a set, numbers of the sets linked to it), each link once; with ``apart`` only
    links between sets of different values there. Without ``every``, links that connect whatever
    is connected."""
    sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    owner = np.repeat(np.arange(len(sets)), sizes)
    lists = owner[np.argsort(codes, kind="stable")]
    lengths = np.bincount(codes)
    ends = np.cumsum(lengths)
    whole = owner * len(lengths) + codes  # ascending, since sets are sorted
    root = np.arange(len(sets))
    done = np.zeros(len(sets), bool)

    def merged(tokens: np.ndarray) -> np.ndarray:
        many = lengths[tokens]
        at = np.repeat(ends[tokens] - many, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        return np.bincount(lists[at], minlength=len(sets))

    for q in np.argsort(sizes, kind="stable").tolist():
        done[q] = True
        n = int(sizes[q])
        if not n:
            continue
        own = codes[bounds[q] : bounds[q + 1]]
        own = own[np.argsort(lengths[own], kind="stable")]
        least = -(-n * 80 // 100)
        skip = min(least - 1, int(least / (MU * np.log2(max(lengths[own[-1]], 2)) + 1)))
        short, long = own[: n - skip], own[n - skip :]
        short = short[lengths[short] > 1]
        if not len(short):
            continue
        seen = merged(short)
        open_ = ~done if every else root != root[q]
        if apart is not None:
            open_ &= apart != apart[q]
        found = np.flatnonzero((seen >= least - skip) & open_ & (sizes * 100 >= sizes[q] * 80) & (sizes * 80 <= sizes[q] * 100))
        if not len(found):
            continue
        if len(found) * len(long) * 10 > lengths[long].sum() + len(sets):
            shared = (seen + merged(long))[found]
        else:
            wanted = (found[:, None] * len(lengths) + np.sort(long)).reshape(-1)
            place = np.minimum(np.searchsorted(whole, wanted), len(whole) - 1)
            shared = seen[found] + np.count_nonzero((whole[place] == wanted).reshape(len(found), -1), axis=1)
        found = found[100 * shared >= PERCENT * (n + sizes[found] - shared)]
        if len(found):
            yield q, found
            if not every:
                root[np.isin(root, root[found])] = root[q]


def divide_skip(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """All links, as pairs of numbers of ``sets``."""
    return [(q, c) for q, found in linked(sets) for c in found.tolist()]


def _verify(rows: list[tuple], every: bool = True) -> list[tuple]:
    """Rows (first, node, check, docs, block, cross, keys): edges (a, b, 0) that connect the linked
    ones, and (a, a, number of documents linked to a by this task)."""
    rows.sort(key=lambda r: r[:3])
    first, docs = (np.array([r[k] for r in rows], np.int64) for k in (0, 3))
    apart = np.unique([r[4] for r in rows], return_inverse=True)[1] if rows[0][5] else None
    counts, a, b = np.zeros(len(rows), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    pending, waiting = [(a, b)], 0

    for q, found in linked([np.frombuffer(r[6], dtype=np.uint64) for r in rows], apart, every):
        counts[q] += docs[found].sum()
        counts[found] += docs[q]
        pending.append((np.full(len(found), q), found))
        waiting += len(found)
        if waiting > 1_000_000:
            a, b = forest(*map(np.concatenate, zip(*pending, strict=True)))
            pending, waiting = [(a, b)], 0
    a, b = forest(*map(np.concatenate, zip(*pending, strict=True)))
    some = np.flatnonzero(counts)
    nothing = [0] * len(a)
    return [*zip(first[a].tolist(), first[b].tolist(), nothing, strict=True), *zip(first[some].tolist(), first[some].tolist(), counts[some].tolist(), strict=True)]


def link_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: bool = True) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of each row: the number of other documents
    linked to it, copies included, null for a null id. Without ``every`` there is no n_links."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rid = first_number()
        for batch in slices(batches):
            out = []
            for doc_id, keys in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), WORDS), strict=True):
                node, check = signature(keys)
                first = doc_id is not None and len(keys) and (node, check) not in seen
                if first:
                    seen.add((node, check))
                size = int(prefix_size(len(keys)) + spare(len(keys)))
                out.append((rid, doc_id, len(keys), node, check, keys[:size].tobytes() if first else None))
                rid += 1
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["rid", "doc_id", "n", "node", "check", "prefix"])

    described = spill(rows.mapInArrow(lean(describe), "rid long, doc_id long, n long, node long, check long, prefix binary"), "shingles")
    near = candidates(described)
    classes = described.filter("n > 0 and doc_id is not null").groupBy("node", "check", "n").agg(F.min("doc_id").alias("first"), F.count("*").alias("docs"))
    classes = spill(classes, "classes")
    placed = described.join(near.withColumnRenamed("node", "rid"), "rid").groupBy("node", "check").agg(F.min("component").alias("component"))
    assigned = tasks(classes.join(placed, ["node", "check"])).withColumn("cross", F.expr("task not in ('all', concat_ws('.', block, block))"))
    assigned = spill(assigned, "assigned")
    bits = _id_bits(assigned)

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            ids = batch.column(0).fill_null(0).to_numpy()
            keep = np.flatnonzero(in_bitmap(bits, mix(ids.astype(np.uint64)).view(np.int64)) & batch.column(0).is_valid().to_numpy(zero_copy_only=False))
            if not len(keep):
                continue
            keys = shingle_sets(batch.column(1).take(pa.array(keep)), WORDS)
            marks = [signature(x) for x in keys]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[keep]), pa.array([x for x, _ in marks], pa.int64()), pa.array([x for _, x in marks], pa.int64()), pa.array([x.tobytes() for x in keys], pa.binary())],
                names=["first", "node", "check", "keys"],
            )

    key = ["first", "node", "check"]
    sets = rows.mapInArrow(lean(full), "first long, node long, check long, keys binary")
    found = spill(met(assigned, sets, key, [*key, "docs", "block", "cross"], partial(_verify, every=every), "a long, b long, links long"), "links")
    joined = components(found)
    own = classes.join(joined.withColumnRenamed("node", "first"), "first", "left").withColumn("class_id", F.coalesce("component", "first"))
    columns = []
    if every:
        counts = found.filter("links > 0").groupBy(F.col("a").alias("first")).agg(F.sum("links").alias("links"))
        own = own.join(counts, "first", "left").withColumn("class_links", F.col("docs") - 1 + F.coalesce("links", F.lit(0)))
        columns = [F.when(F.col("doc_id").isNotNull(), F.coalesce("class_links", F.lit(0))).alias("n_links")]
    out = described.join(own.select("node", "check", "class_id", *(["class_links"] if every else [])), ["node", "check"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id")).alias("component_id"), *columns)


def _id_bits(assigned: DataFrame) -> np.ndarray:
    """A bitmap of the record ids, under the hash that tasks use too."""
    return bitmap(assigned.select("first").distinct().mapInArrow(lean(_mixed), "k long"), "k")


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().astype(np.uint64)).view(np.int64))], names=["k"])


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of least id of each component."""
    gone = link_components(docs, every=False).filter("component_id < doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op5_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """All whole documents: the size of each one's set, its component, and its number of links."""
    return link_components(table(spark, sf_dir, "documents"))


def op5_link_counts(spark, sf_dir: str) -> DataFrame:
    """The numbers of links alone."""
    return link_components(table(spark, sf_dir, "documents")).select("doc_id", "n_links")


OP5_SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM t),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b)
SELECT s.doc_id, CAST(len(any_value(sh)) AS BIGINT) AS n_shingles, min(r.b) AS component_id,
    coalesce(any_value(c.many), 0) AS n_links FROM s JOIN reach r ON r.a = s.doc_id LEFT JOIN (SELECT a, count(*) AS many FROM pairs GROUP BY a) c ON c.a = s.doc_id GROUP BY s.doc_id"""
OP5_LINKS_SQL = f"SELECT doc_id, n_links FROM ({OP5_SQL}) q"

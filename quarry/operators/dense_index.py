"""A stored index for dense search: inverted lists of product-quantised vectors.

Unit vectors are dealt to the nearest of some centroids (k-means over all vectors, distributed), and
what remains of each is cut into parts, each written as the number of the nearest word of a codebook
(from a bounded sample). A folder holds a directory for each list; a row has its codes and its
vector, in columns of their own. A search reads the codes of the lists nearest to the query, adds
up the products of its parts with the words, and scores the best of them again, exactly, on their
vectors. With all lists and all candidates it is the exact search.

How many lists a search probes, and how many candidates it scores again, is measured when the index is
built: as many as bring the wanted recall on a bounded sample of the vectors, held against all of them.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.expressions import cosine, normalised
from quarry.session import stored

#: Lists at most, and vectors of a list on average below that.
MOST_LISTS, EACH = 4096, 100
#: Numbers of the sample that codebooks are learned from, words of a codebook, components of a part.
SAMPLE_NUMBERS, WORDS, PART = 1 << 21, 256, 8
#: Candidates that are scored again, for each result, at least.
AGAIN = 20
#: Vectors of the sample that recall is measured on.
MEASURED = 64
#: Rows, and queries, that a task of a search for many queries holds.
TOGETHER, ASKED = 1 << 15, 1 << 12
#: Pairs of a query and a candidate that are multiplied at once.
PAIRS = 1 << 15


def learned(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k words for the rows of a sample, by Lloyd's rounds."""
    rng = np.random.default_rng(len(x))
    words = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ words.T - 0.5 * (words**2).sum(axis=1), axis=1)
        many = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], words)
    return words


def parts_of(size: int) -> list[tuple[int, int]]:
    return [(at, min(size, at + PART)) for at in range(0, size, PART)]


def _rows(column: pa.Array, size: int) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)


def _first(scores: np.ndarray, order: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the ``most`` greatest finite numbers of each row, ties by ``order``."""
    if most < scores.shape[1]:
        least = -np.partition(-scores, most - 1, axis=1)[:, most - 1]
        for row, at in zip(scores, least, strict=True):
            tied = np.flatnonzero(row == at)
            spare = len(tied) - (most - np.count_nonzero(row > at))
            if spare > 0:
                row[tied[np.argsort(order[tied])[len(tied) - spare :]]] = -np.inf
        scores[scores < least[:, None]] = -np.inf
    row, column = np.nonzero(scores > -np.inf)
    return row, column, scores[row, column]


def _ordered(ids: pa.Array) -> np.ndarray:
    """The rank of each id."""
    return np.argsort(np.argsort(np.array(ids.to_pylist()), kind="stable"))


def _products(queries: np.ndarray, centroids: np.ndarray, books: list[np.ndarray]) -> list[np.ndarray]:
    """Of queries with centroids, and of their parts with words."""
    return [queries @ centroids.T, *(queries[:, a:b] @ w.T for (a, b), w in zip(parts_of(centroids.shape[1]), books, strict=True))]


def _guesses(products: list[np.ndarray], lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The products of queries with quantised rows: equal for rows of equal list and codes."""
    out = products[0][:, lists]
    for j, table in enumerate(products[1:]):
        out += table[:, codes[:, j]]
    return out


def _multiplied(x: np.ndarray, row: np.ndarray, y: np.ndarray, column: np.ndarray) -> np.ndarray:
    """The product of each pair of rows, as many at once as memory should hold."""
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[row[at : at + PAIRS]], y[column[at : at + PAIRS]]) for at in range(0, len(row), PAIRS))])


def _picked(left: pa.Table, right: pa.Table, found: list[tuple]) -> pa.Table:
    """(query, id, score) of the rows that were found, blocks of queries one after the other."""
    of = pa.array(np.concatenate([np.empty(0, np.int64), *(at + row for at, row, _, _ in found)]))
    to = pa.array(np.concatenate([np.empty(0, np.int64), *(column for _, _, column, _ in found)]))
    return pa.table({"query": left.column("query").take(of), "id": right.column("id").take(to), "score": pa.array(np.concatenate([np.empty(0), *(score for *_, score in found)]))})


def usable(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vector) of the rows with a vector of finite numbers that is not zero."""
    x = F.col(vector)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    return chunks.filter(whole & F.exists(x, lambda v: v != 0)).select(F.col(key).alias("id"), x.cast("array<double>").alias("vector"))


class DenseIndex:
    """``lists/list=<n>`` (id, codes, vector) below a folder, and ``model``: centroids, codebooks, probes, again."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._model: dict | None = None

    # -- building
    def build(self, chunks: DataFrame, key: str = "id", vector: str = "embedding", lists: int | None = None, recall: float = 0.95, k: int = 10) -> DenseIndex:
        """Index a collection. Vectors of another length than the first sampled one are an error."""
        rows = stored(usable(chunks, key, vector).withColumn("unit", normalised(F.col("vector"))), "vectors")
        shape = rows.agg(F.count("*").alias("n"), F.max(F.size("unit")).alias("size"), F.min(F.size("unit")).alias("least")).first()
        if shape["size"] != shape["least"]:
            raise ValueError("all vectors of an index have one length")
        if not shape["n"]:
            self._save({"centroids": [], "codebooks": [], "probes": 0, "key": rows.schema["id"].dataType.simpleString()})
            return self
        size = shape["size"]
        wanted = lists or max(1, min(MOST_LISTS, shape["n"] // EACH))
        if wanted == 1:
            centroids = np.zeros((1, size))
        else:
            model = KMeans(k=wanted, seed=1, maxIter=10, featuresCol="f", predictionCol="list").fit(rows.select(array_to_vector("unit").alias("f")))
            centroids = np.array(model.clusterCenters())
        sample = self._sample(rows, shape["n"], max(WORDS, SAMPLE_NUMBERS // size))
        rest = sample - centroids[np.argmax(sample @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)]
        books = [learned(rest[:, a:b], WORDS) for a, b in parts_of(size)]

        def code(batches):
            for batch in batches:
                x = np.array(batch.column("unit").flatten().to_numpy(zero_copy_only=False)).reshape(-1, size)
                near = np.argmax(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1), axis=1)
                left = x - centroids[near]
                codes = np.column_stack([np.argmax(left[:, a:b] @ w.T - 0.5 * (w**2).sum(axis=1), axis=1) for (a, b), w in zip(parts_of(size), books, strict=True)])
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(codes.astype(np.int16)), pa.list_(pa.int16())), batch.column("vector"), pa.array(near, pa.int32())], names=["id", "codes", "vector", "list"])

        kind = rows.schema["id"].dataType.simpleString()
        coded = rows.mapInArrow(code, f"id {kind}, codes array<smallint>, vector array<double>, list int")
        coded.hint("rebalance", "list").sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/lists")
        self._save({"centroids": centroids.tolist(), "codebooks": [w.tolist() for w in books], "probes": len(centroids), "key": kind})
        self._save(self.model | self._measured(sample[:MEASURED], recall, k))
        return self

    def _sample(self, rows: DataFrame, count: int, most: int) -> np.ndarray:
        """Unit vectors of the smallest hashes, ``most`` at most. Copies of a vector are drawn one by one: in a
        hash of vectors alone they would come together, and could be all that recall is measured on."""
        drawn = F.shiftrightunsigned(F.xxhash64("id", "vector"), 24)
        found = rows.filter(drawn <= int(min(1.0, most / count) * (1 << 40))).orderBy(drawn, "id").limit(most).select("unit")
        return np.array([r[0] for r in found.collect()])

    def _measured(self, queries: np.ndarray, recall: float, k: int) -> dict[str, int]:
        """The least numbers of lists and of candidates, for each result, that bring the wanted recall, mean over
        sampled queries: of each one's true nearest but itself, the ranks of their lists and of their guesses
        among all rows. Of those that may be missed, half may lie in other lists and half behind other guesses."""
        kind, (centroids, books) = self.model["key"], self._words()
        size, products = centroids.shape[1], _products(queries, centroids, books)

        def guessed(batch: pa.RecordBatch) -> np.ndarray:
            return _guesses(products, batch.column("list").to_numpy(), _rows(batch.column("codes"), len(books)))

        def best(batches):
            for batch in batches:
                x = _rows(batch.column("vector"), size)
                scores = np.round(queries @ (x / np.linalg.norm(x, axis=1, keepdims=True)).T, 12)
                row, column, score = _first(scores, _ordered(batch.column("id")), k + 1)
                to = pa.array(column)
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int32()), pa.array(score), pa.array(guessed(batch)[row, column]), batch.column("id").take(to), batch.column("list").take(to)], names=["q", "score", "guess", "id", "list"])

        found = self.lists().mapInArrow(best, f"q int, score double, guess double, id {kind}, list int")
        ranked = found.withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(F.col("n").between(2, k + 1))
        nearest = [tuple(r) for r in ranked.select("q", "guess", "id", "list").collect()]  # k rows for each sampled query
        if not nearest:
            return {"probes": len(centroids), "again": AGAIN}

        def before(batches):
            counts = np.zeros(len(nearest), dtype=np.int64)
            for batch in batches:
                if batch.num_rows:
                    guesses, ids = guessed(batch), np.array(batch.column("id").to_pylist())
                    for i, (q, guess, own, _) in enumerate(nearest):
                        counts[i] += np.count_nonzero(guesses[q] > guess) + np.count_nonzero(ids[guesses[q] == guess] < own)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(nearest)), pa.int32()), pa.array(counts)], names=["i", "rank"])

        behind = self.lists().select("id", "codes", "list").mapInArrow(before, "i int, rank long").groupBy("i").agg(F.sum("rank"))
        order = np.argsort(np.argsort(-(products[0] - 0.5 * (centroids**2).sum(axis=1)), axis=1), axis=1)
        most = min(len(nearest), int(np.ceil((1 + recall) / 2 * len(nearest)))) - 1
        probes, candidates = (int(np.sort(ranks)[most]) + 1 for ranks in ([order[q, c] for q, _, _, c in nearest], [r[1] for r in behind.collect()]))
        return {"probes": probes, "again": max(AGAIN, -(-candidates // k))}

    def _save(self, model: dict) -> None:
        text = json.dumps(model)
        self.spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/model")
        self._model = model

    @property
    def model(self) -> dict:
        if self._model is None:
            self._model = json.loads(self.spark.read.text(f"{self.path}/model").first()[0])
        return self._model

    def _words(self) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.array(self.model["centroids"]), [np.array(w) for w in self.model["codebooks"]]

    # -- searching
    def lists(self) -> DataFrame:
        """All rows, with their list."""
        return self.spark.read.schema(f"id {self.model['key']}, codes array<smallint>, vector array<double>, list int").parquet(f"{self.path}/lists")

    def probed(self, query: list[float], probes: int) -> list[int]:
        q, centroids = np.array(query, dtype=float), np.array(self.model["centroids"])
        unit = q / np.linalg.norm(q)
        return [int(c) for c in np.argsort(-(unit @ centroids.T - 0.5 * (centroids**2).sum(axis=1)), kind="stable")[:probes]]

    def estimate(self, query: list[float], which: list[int]) -> Column:
        """The product of a row's quantised vector with the unit query, from its list and codes."""
        q, centroids = np.array(query, dtype=float), np.array(self.model["centroids"])
        unit = q / np.linalg.norm(q)
        base = F.create_map(*[F.lit(x) for c in which for x in (c, float(unit @ centroids[c]))])[F.col("list")]
        out = base
        for j, ((a, b), words) in enumerate(zip(parts_of(len(unit)), self.model["codebooks"], strict=True)):
            table = F.array(*[F.lit(float(v)) for v in np.array(words) @ unit[a:b]])
            out = out + F.get(table, F.get(F.col("codes"), j).cast("int"))
        return out

    def search(self, query: list[float], k: int, probes: int | None = None, again: int | None = None) -> DataFrame:
        """(id, score) of the k nearest: cosines of the best candidates of the probed lists, ties by id.
        ``probes``: lists, ``again``: candidates for each result; ``exact()`` reads them all."""
        if not self.model["centroids"]:
            return self.spark.createDataFrame([], f"id {self.model['key']}, score double")
        which = self.probed(query, probes or self.model["probes"])
        held = self.lists().filter(F.col("list").isin(which))
        best = held.select("id", "list", self.estimate(query, which).alias("guess")).orderBy(F.desc("guess"), "id").limit((again or self._again()) * k)
        return self._scored(held.join(best, ["list", "id"], "left_semi"), query).limit(k)

    def _again(self) -> int:
        """Candidates for each result; an index of old has not measured them."""
        return self.model.get("again", AGAIN)

    def _scored(self, rows: DataFrame, query: list[float]) -> DataFrame:
        wanted = F.array(*[F.lit(float(x)) for x in query])
        return rows.select("id", cosine(F.col("vector"), wanted).alias("score")).orderBy(F.desc("score"), "id")

    def exact(self, query: list[float], k: int) -> DataFrame:
        """(id, score) of the k nearest of all lists."""
        return self._scored(self.lists(), query).limit(k)

    def search_all(self, queries: DataFrame, k: int, probes: int | None = None, again: int | None = None) -> DataFrame:
        """(query, id, score) for many queries (query, vector): each goes to the groups of lists that it probes
        and meets their codes there, and the vectors of its again x k best candidates of the group. A task holds
        a block of queries and a group of rows, and hands on the k best of each query, ties by id."""
        if not self.model["centroids"]:
            return self._none(queries)
        centroids, books = self._words()
        size, many, most = centroids.shape[1], probes or self.model["probes"], (again or self._again()) * k
        counts = dict(self.lists().groupBy("list").count().collect())  # a row for each list
        group, groups = np.zeros(len(centroids), dtype=np.int64), []
        for c in range(len(centroids)):
            if not groups or groups[-1] + counts.get(c, 0) > TOGETHER:
                groups.append(0)
            groups[-1] += counts.get(c, 0)
            group[c] = len(groups) - 1
        parts = [max(1, -(-n // TOGETHER)) for n in groups]  # a list that is too large for a task is dealt out
        near = lambda x: np.argsort(-(x @ centroids.T - 0.5 * (centroids**2).sum(axis=1)), axis=1, kind="stable")[:, :many]

        def sent(batches):
            for batch in batches:
                x = _rows(batch.column(2), size)
                own = [np.unique(group[lists]) for lists in near(x / np.linalg.norm(x, axis=1, keepdims=True))] or [np.empty(0, np.int64)]
                to = [(r, g, p) for r, found in enumerate(own) for g in found for p in range(parts[g])]
                of = pa.array([t[0] for t in to], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(of) for c in range(3)), pa.array([t[1] for t in to], pa.int32()), pa.array([t[2] for t in to], pa.int32())], names=["query", "block", "vector", "group", "part"])

        kinds = (queries.schema["query"].dataType.simpleString(), self.model["key"])
        asked, blocks = self._blocks(queries)
        dealt = asked.mapInArrow(sent, f"query {kinds[0]}, block int, vector array<double>, group int, part int")
        placed = F.get(F.array(*[F.lit(int(g)) for g in group]), F.col("list"))
        dealt_to = F.pmod(F.xxhash64("id"), F.get(F.array(*[F.lit(n) for n in parts]), F.col("group"))).cast("int")
        rows = self.lists().withColumn("group", placed).withColumn("part", dealt_to).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
            right = right.sort_by([("list", "ascending"), ("id", "ascending")])
            found = []
            if left.num_rows and right.num_rows:
                x, y = (_rows(t.column("vector").combine_chunks(), size) for t in (left, right))
                x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
                codes, lists = _rows(right.column("codes").combine_chunks(), len(books)), right.column("list").to_numpy()
                runs = [(int(c), *np.searchsorted(lists, [c, c + 1])) for c in np.unique(lists)]
                order = _ordered(right.column("id"))
                for at in range(0, len(x), 256):
                    some = x[at : at + 256]
                    probed = np.zeros((len(some), len(centroids)), dtype=bool)
                    np.put_along_axis(probed, near(some), True, axis=1)
                    products, scores = _products(some, centroids, books), np.full((len(some), len(codes)), -np.inf)
                    for c, start, end in runs:
                        which = np.flatnonzero(probed[:, c])
                        scores[which, start:end] = _guesses([p[which] for p in products], lists[start:end], codes[start:end])
                    row, column, _ = _first(scores, order, most)
                    scores.fill(-np.inf)
                    scores[row, column] = np.round(_multiplied(some, row, y, column), 12)
                    found.append((at, *_first(scores, order, k)))
            return _picked(left, right, found)

        met = dealt.groupBy("group", "block", "part").cogroup(rows.groupBy("group", "block", "part")).applyInArrow(nearest, f"query {kinds[0]}, id {kinds[1]}, score double")
        return self._best(met, k)

    def _best(self, met: DataFrame, k: int) -> DataFrame:
        return met.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).filter(F.col("n") <= k).drop("n")

    def _none(self, queries: DataFrame) -> DataFrame:
        return self.spark.createDataFrame([], f"query {queries.schema['query'].dataType.simpleString()}, id {self.model['key']}, score double")

    def _blocks(self, queries: DataFrame) -> tuple[DataFrame, int]:
        """(query, block, vector) and the number of blocks of some thousand queries."""
        many = max(1, -(-queries.count() // ASKED))
        return queries.select("query", F.pmod(F.xxhash64("query"), F.lit(many)).cast("int").alias("block"), F.col("vector").cast("array<double>").alias("vector")), many

    def exact_all(self, queries: DataFrame, k: int) -> DataFrame:
        """(query, id, score): the k nearest of all rows for many queries (query, vector), ties by id. The work is
        queries x rows; a task multiplies a block of queries by a part of the rows and hands on the k best of
        each query. Cosines are equal that differ by rounding alone."""
        if not self.model["centroids"]:
            return self._none(queries)
        size = len(self.model["centroids"][0])
        kinds = (queries.schema["query"].dataType.simpleString(), self.model["key"])
        held = self.lists().select("id", "vector")
        parts = max(1, -(-held.count() // TOGETHER))
        asked, blocks = self._blocks(queries)
        dealt = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        rows = held.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
            found = []
            if left.num_rows and right.num_rows:
                x, y = (_rows(t.column("vector").combine_chunks(), size) for t in (left, right))
                x, y = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
                order = _ordered(right.column("id"))
                for at in range(0, len(x), 256):
                    found.append((at, *_first(np.round(x[at : at + 256] @ y.T, 12), order, k)))
            return _picked(left, right, found)

        met = dealt.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInArrow(nearest, f"query {kinds[0]}, id {kinds[1]}, score double")
        return self._best(met, k)

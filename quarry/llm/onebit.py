"""Approximate nearest neighbours by randomly rotated one-bit codes.

A unit vector u is coded against the centre c of its cell: the signs of the rotated u - c, packed,
and three numbers: the length of u - c, its product with c, and how well the signs point its way.
The product of u with a query follows from the packed bits, counted against the bit planes of the
query's rotated and rounded rest, within an error that shrinks with the number of components; the
bound used is ``SURE`` standard errors. Only vectors whose greatest possible score reaches the k-th
greatest certain one are scored exactly, on the original vectors.

Equal vectors are one record with its k + 1 smallest ids: no query needs more of them, however many
copies there are. Cells come from a bounded sample; cells are cut into blocks of bounded size, and
the queries of a cell into parts. A query first searches the cell it is nearest to, then every
cell in which a vector could reach the score that it has by then: a cell is passed over only if the
angle between the query and its centre and the widest angle within the cell rule it out. ``probes``
bounds the number of cells instead, for collections on which that is too slow; the result is then
approximate in this too.

Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id. Shorter vectors count as filled up with zeros. Rows equal in id and vector count once;
rows of one id with different vectors are different rows, each a query and a candidate of its own.
Ties go to the smaller id. An empty table gives an empty result. Other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm.common import lean, spill, table

#: Results of a query; one id in so many is a query.
NEAREST, EACH = 5, 50
#: Numbers of the sample that cells are learned from (documented bound), and centre components at most.
SAMPLE_NUMBERS, CENTRE_NUMBERS = 1 << 21, 1 << 19
#: Vectors of a cell, on average, up to the greatest number of cells; numbers of the vectors, and of the queries, of a comparison.
CELL, MOST_CELLS, BLOCK_NUMBERS, QUERY_NUMBERS = 4096, 1024, 1 << 19, 1 << 18
#: Bits of a query's rounded components; standard errors of the bound on an estimate.
PLANES, SURE = 8, 4.0
#: Rounding of estimates and of angles.
SLACK, ANGLE_SLACK = 1e-9, 1e-7


def rotation(size: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every run; sizes are filled up to whole words of bits."""
    q, r = np.linalg.qr(np.random.default_rng(size).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def words(size: int) -> int:
    return -(-size // 64) * 64


def filled(vectors: pa.Array, size: int) -> np.ndarray:
    """A matrix of the vectors, zeros behind the shorter ones."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    lengths = np.diff(vectors.offsets.to_numpy())
    if len(lengths) and (lengths == size).all():
        return flat.reshape(-1, size)
    out = np.zeros((len(lengths), size))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def units(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Codes:
    """Packed signs and correction numbers of unit vectors against their cell's centre."""

    def __init__(self, u: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = u - centre
        self.length = np.linalg.norm(rest, axis=1)
        turned = np.zeros((len(u), turn.shape[0]))
        turned[:, : u.shape[1]] = rest
        turned = turned @ turn.T
        self.bits = np.packbits(turned > 0, axis=1, bitorder="little").view(np.uint64)
        self.along = rest @ centre
        with np.errstate(invalid="ignore", divide="ignore"):
            aligned = np.abs(turned).sum(axis=1) / (np.sqrt(turn.shape[0]) * self.length)
        self.aligned = np.where(self.length > 0, aligned, 1.0)


class Asked:
    """Unit queries against a cell's centre: rounded rotated rests as bit planes."""

    def __init__(self, v: np.ndarray, centre: np.ndarray, turn: np.ndarray):
        rest = np.zeros((len(v), turn.shape[0]))
        rest[:, : v.shape[1]] = v - centre
        self.centred, self.length = v @ centre, np.linalg.norm(rest, axis=1)
        turned = rest @ turn.T
        self.low = turned.min(axis=1)
        self.step = np.maximum((turned.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-300)
        level = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        self.off = np.linalg.norm(turned - self.low[:, None] - level * self.step[:, None], axis=1)
        self.total = level.sum(axis=1) * self.step + turn.shape[0] * self.low
        self.planes = [np.packbits((level >> j) & 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)]


def estimates(asked: Asked, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Products of all queries with all vectors, and the bound on their errors."""
    size = codes.bits.shape[1] * 64
    ones = np.bitwise_count(codes.bits).sum(axis=1, dtype=np.int64)
    both = np.zeros((len(asked.length), len(codes.length)), dtype=np.int64)
    for j, plane in enumerate(asked.planes):
        for w in range(codes.bits.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & codes.bits[None, :, w]).astype(np.int64) << j
    set_ = both * asked.step[:, None] + asked.low[:, None] * ones[None]
    signs = (2 * set_ - asked.total[:, None]) / np.sqrt(size)
    scale = codes.length / codes.aligned
    found = asked.centred[:, None] + codes.along[None] + signs * scale[None]
    missed = codes.length * np.sqrt(np.maximum(0, 1 - codes.aligned**2)) / codes.aligned / np.sqrt(max(1, size - 1))
    return found, SURE * asked.length[:, None] * missed[None] + asked.off[:, None] * scale[None] + SLACK


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, in double precision, summed from the first component to the last."""
    xy, xx, yy = (np.cumsum(a * b, axis=1)[:, -1] for a, b in ((x, y), (x, x), (y, y)))
    return xy / (np.sqrt(xx) * np.sqrt(yy))


def search(queries: np.ndarray, reached: np.ndarray, vectors: np.ndarray, centre: np.ndarray, codes: Codes, turn: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a block that may be among the k nearest of each query, with their scores."""
    for at in range(0, len(queries), 128):
        part = queries[at : at + 128]
        found, off = estimates(Asked(units(part), centre, turn), codes)
        sure = reached[at : at + 128].copy()
        if found.shape[1] >= k:
            sure = np.maximum(sure, -np.partition(-(found - off), k - 1, axis=1)[:, k - 1])
        own, of = np.nonzero(found + off >= sure[:, None])
        for q, ends in zip(range(len(part)), np.searchsorted(own, np.arange(len(part) + 1))[1:], strict=True):
            which = of[np.searchsorted(own, q) : ends]
            if len(which):
                yield at + q, which, exact(np.broadcast_to(part[q], (len(which), len(part[q]))), vectors[which])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, vector) of the rows that take part, each once."""
    x = F.col(vector_col)
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    some = F.exists(x, lambda v: v != 0)
    kept = vectors.filter(F.col(id_col).isNotNull() & whole & some).select(F.col(id_col).cast("long").alias("id"), x.cast("array<double>").alias("vector"))
    return kept.dropDuplicates(["id", "vector"])


def classes(rows: DataFrame, k: int) -> DataFrame:
    """(vector, ids): each distinct vector with its k + 1 smallest ids; a group limit keeps hot vectors small."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("vector").orderBy("id"))).filter(F.col("rank") <= k + 1)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def centres(stored: DataFrame, size: int, count: int) -> np.ndarray:
    """Centres of cells, by k-means on a bounded sample: the vectors of the smallest hashes."""
    rows = max(1, SAMPLE_NUMBERS // size)
    drawn = F.shiftrightunsigned(F.xxhash64("vector"), 24)  # 40 bits
    sample = stored.select("vector").filter(drawn <= int(min(1.0, rows / count) * (1 << 40))).orderBy(drawn, "vector").limit(rows)
    x = units(filled(sample.toArrow().column(0).combine_chunks().cast(pa.list_(pa.float64())), size))
    k = max(1, min(MOST_CELLS, -(-count // CELL), len(x), CENTRE_NUMBERS // size))
    rng = np.random.default_rng(k)
    out = x[rng.choice(len(x), k, replace=False)]
    for _ in range(10):
        near = np.argmax(x @ out.T - 0.5 * (out**2).sum(axis=1), axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, near, x)
        many = np.bincount(near, minlength=k)
        out = np.where(many[:, None] > 0, sums / np.maximum(many, 1)[:, None], out)
    return out


def _nearest_cell(u: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.argmax(u @ middle.T - 0.5 * (middle**2).sum(axis=1), axis=1)


def _angles(u: np.ndarray, middle: np.ndarray) -> np.ndarray:
    """Angles between unit vectors and centres; a centre at the origin is no direction: 0."""
    norm = np.linalg.norm(middle, axis=1)
    return np.where(norm > 0, np.arccos(np.clip(u @ middle.T / np.where(norm > 0, norm, 1), -1, 1)), 0.0)


class Index:
    """Blocks of coded vectors by cell, in the shared folder."""

    def __init__(self, vectors: DataFrame, k: int = NEAREST):
        """``vectors``: (id, vector), usable."""
        spark = vectors.sparkSession
        self.k = k
        self.stored = spill(classes(vectors, k), "classes")
        shape = self.stored.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("size")).first()
        self.count, self.size = shape["n"], shape["size"] or 1
        self.blocks = None
        if not self.count:
            return
        self.turn = rotation(words(self.size))
        self.centres = centres(self.stored, self.size, self.count)
        middle, size = self.centres, self.size

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = units(filled(batch.column(0), size))
                cell = _nearest_cell(u, middle)
                angle = _angles(u, middle)[np.arange(len(u)), cell]
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(angle), *batch.columns], names=["cell", "angle", "vector", "ids"])

        placed_ = self.stored.select("vector", "ids").mapInArrow(lean(placed), "cell int, angle double, vector array<double>, ids array<long>")
        cells = placed_.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("wide")).collect()  # a row for each cell
        block = max(1, BLOCK_NUMBERS // size)
        self.parts = {r["cell"]: -(-r["n"] // block) for r in cells}
        self.wide = {r["cell"]: r["wide"] for r in cells}
        parts = _by_cell(self.parts)
        part = F.pmod(F.xxhash64("vector"), parts).cast("int")
        turn = self.turn

        def coded(key: tuple, group: pa.Table) -> pa.Table:
            group = group.combine_chunks()
            x = filled(group.column("vector").chunk(0) if group.num_rows else pa.array([], pa.list_(pa.float64())), size)
            codes = Codes(units(x), middle[key[0].as_py()], turn)
            binary = [pa.array([a.tobytes()], pa.binary()) for a in (x, codes.bits, codes.length, codes.along, codes.aligned)]
            return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([group.column("ids").to_pylist()], pa.list_(pa.list_(pa.int64()))), *binary], names=[c.split()[0] for c in _BLOCK.split(", ")])

        self.blocks = spill(placed_.withColumn("part", part).groupBy("cell", "part").applyInArrow(coded, _BLOCK), "codes")

    def _compared(self, asked: DataFrame) -> DataFrame:
        """The best of each block for each query (query, vector, cell, reached) that is sent to its cell: (query, score, id,
        same); same: the id is that of a row with the query's own vector."""
        middle, turn, size, k = self.centres, self.turn, self.size, self.k + 1
        counts = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each cell
        lot = max(1, QUERY_NUMBERS // size)
        lots = _by_cell({c: -(-n // lot) for c, n in counts.items()})
        blocks = self.blocks.filter(F.col("cell").isin(list(counts))).withColumn("lot", F.explode(F.sequence(F.lit(0), (lots - 1).cast("int"))))
        sent = asked.withColumn("lot", F.pmod(F.xxhash64("query"), lots).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), (_by_cell(self.parts) - 1).cast("int"))))

        def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if left.num_rows and right.num_rows:
                x = filled(left.combine_chunks().column("vector").chunk(0), size)
                queries, reached = left.column("query").to_pylist(), left.column("reached").to_numpy()
                block = {n: right.column(n)[0].as_py() for n in right.column_names}
                codes = object.__new__(Codes)
                codes.bits = np.frombuffer(block["bits"], np.uint64).reshape(len(block["ids"]), -1)
                codes.length, codes.along, codes.aligned = (np.frombuffer(block[n]) for n in ("length", "along", "aligned"))
                vectors = np.frombuffer(block["vectors"]).reshape(-1, size)
                for q, which, scores in search(x, reached, vectors, middle[key[0].as_py()], codes, turn, k):
                    least = np.partition(scores, -k)[-k] if len(scores) > k else -2.0
                    own = (vectors[which] == x[q]).all(axis=1)
                    rows = [(-s, j, same) for i, s, same in zip(which, scores.tolist(), own.tolist(), strict=True) if s >= least for j in block["ids"][i]]
                    out += [(queries[q], -s, j, same) for s, j, same in sorted(rows)[:k]]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64(), pa.bool_()), strict=True)], names=["query", "score", "id", "same"])

        keys = ("cell", "part", "lot")
        return sent.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInArrow(run, "query string, score double, id long, same boolean")

    def nearest(self, queries: DataFrame, probes: int | None = None) -> DataFrame:
        """(query, found): the k + 1 nearest (score, id, same) of each query (query, vector), nearest first, its
        own row among them."""
        middle, size, wide, k = self.centres, self.size, self.wide, self.k + 1

        def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.array(sorted(wide))
            for batch in batches:
                cell = held[_nearest_cell(units(filled(batch.column(1), size)), middle[held])]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.full(len(cell), -2.0))], names=["query", "vector", "cell", "reached"])

        def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = np.array(sorted(wide))
            widest = np.array([wide[c] for c in held])
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    rows = batch.slice(at, 512)
                    u = units(filled(rows.column(1), size))
                    reached = rows.column(2).to_numpy()
                    angle = _angles(u, middle[held])
                    open_ = np.cos(np.maximum(0, angle - widest)) >= reached[:, None] - ANGLE_SLACK
                    home = _nearest_cell(u, middle[held])
                    open_[np.arange(len(u)), home] = False
                    if probes is not None:
                        order = np.argsort(np.argsort(angle, axis=1), axis=1)
                        open_ &= order < probes
                    q, c = np.nonzero(open_)
                    yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(q)), rows.column(1).take(pa.array(q)), pa.array(held[c], pa.int32()), pa.array(reached[q])], names=["query", "vector", "cell", "reached"])

        shape = "query string, vector array<double>, cell int, reached double"
        near = spill(self._compared(queries.select("query", "vector").mapInArrow(lean(first), shape)), "near")
        reached = near.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(F.lit(-2.0)).alias("reached"))
        more = spill(queries.join(reached, "query").select("query", "vector", "reached").mapInArrow(lean(others), shape), "probes")
        both = near if more.isEmpty() else near.unionByName(self._compared(more))
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranked = both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        return ranked.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score", "id", "same"))), lambda x: F.struct(x["score"].alias("score"), x["id"].alias("id"), x["same"].alias("same"))).alias("found"))


def _by_cell(numbers: dict[int, int]):
    """A number for each cell, as a column; 1 for the others. There are ``MOST_CELLS`` cells at most."""
    values = [numbers.get(c, 1) for c in range(max(numbers, default=0) + 1)]
    return F.element_at(F.array(*[F.lit(n) for n in values]), F.col("cell") + 1)


_BLOCK = "cell int, part int, ids array<array<long>>, vectors binary, bits binary, length binary, along binary, aligned binary"
_RESULT = "query_id long, rank int, vec_id long, score double"


def neighbours(vectors: DataFrame, each: int = EACH, k: int = NEAREST, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """The k nearest of every row whose id is divisible by ``each``, among the rows of other ids."""
    spark: SparkSession = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    index = Index(rows, k)
    if index.blocks is None:
        return spark.createDataFrame([], _RESULT)
    asked = rows.filter(F.col("id") % each == 0)
    named = F.concat_ws(":", F.min("id"), F.xxhash64("vector"))  # an id that has several vectors asks once for each
    distinct = spill(asked.groupBy("vector").agg(named.alias("query")), "queries")
    found = index.nearest(distinct, probes)
    mine = asked.join(distinct, "vector").select("id", "query").join(found, "query")
    other = F.slice(F.filter("found", lambda x: ~(x["same"] & (x["id"] == F.col("id")))), 1, k)
    out = mine.select(F.col("id").alias("query_id"), F.posexplode(other).alias("at", "hit"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))


def op11_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth vector of the table."""
    return neighbours(table(spark, sf_dir, "embeddings"))


OP11_SQL = f"""
WITH r AS (SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
v AS (SELECT vec_id, x, list_resize(x, (SELECT max(len(x)) FROM r), 0.0) AS y FROM r),
s AS (SELECT q.vec_id AS query_id, q.x AS own, v.vec_id, list_dot_product(q.y, v.y) / (sqrt(list_dot_product(q.y, q.y)) * sqrt(list_dot_product(v.y, v.y))) AS score
    FROM v q JOIN v ON (v.vec_id, v.x) IS DISTINCT FROM (q.vec_id, q.x) WHERE q.vec_id % {EACH} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= {NEAREST}"""

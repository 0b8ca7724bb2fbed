"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

The rows of each source are numbered and cut into blocks. Weights are positive integers;
a round is one slot for each unit of weight, in which a source gets as many blocks as its
weight. Within a round block j (from 0) of a source with share a of n slots is released at
floor(j*n/a) and due at ceil((j+1)*n/a); slots are given to the released block with the
earliest deadline. That keeps every source within less than one block of its target at
every slot. A source with fewer blocks left than its weight has what is left as its share
of that round and none afterwards, so all rows are scheduled.

Rounds repeat: there are at most two kinds for each source (its last round, and the
rounds without it), so the schedule is worked out once for each kind and looked up for
each row. Nothing in it grows with the number of rows.

A null source is a source of its own. Sources without a stated weight get the default.
The rows of a source lie in the order of a hash of their ids, then by id; rows without an id
in that of their other columns. Repeated rows each get a place. An empty table gives an empty
result. Columns may be called anything: those named like the three results are replaced.

The schedule of a kind costs its slots times the sources, and there are about two kinds for
each source: it is made for mixtures of some hundred sources, not for a source for every host.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType
from pyspark.sql.window import Window

#: Rows of a block.
BLOCK_ROWS = 16
#: Rows that one task numbers at once, about, and the most parts of one source.
ROWS_PER_PART, MOST_PARTS = 2000, 65536
_NULL = "\x00null"

_SCHEDULE = """
aggregate(sequence(1, total), named_struct('done', array_repeat(0L, size(share)), 'out', cast(array() as array<int>)),
  (st, t) -> transform(array(array_min(filter(
      transform(share, (a, i) -> if(a > st.done[i] and floor(st.done[i] * total / a) <= t - 1,
        named_struct('due', cast(ceil((st.done[i] + 1) * total / a) as bigint), 'i', i), null)), x -> x is not null)).i),
    pick -> named_struct('done', transform(st.done, (d, i) -> d + if(i = pick, 1L, 0L)), 'out', array_append(st.out, pick)))[0],
  st -> st.out)
"""


def schedule(docs: DataFrame, weights: Mapping[str, int] | None = None, default: int = 1, source_col: str = "source", id_col: str = "doc_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``docs`` with ``mix_slot`` (the block's place in the mixture, from 0), ``mix_row`` (the
    row's place in its block) and ``mix_block`` (the block's number in its source)."""
    if any(w < 1 for w in [*(weights or {}).values(), default]):
        raise ValueError("weights are positive integers")
    total_rows = docs.count()
    parts = min(MOST_PARTS, max(1, -(-total_rows // ROWS_PER_PART)))
    weight = F.lit(default)
    if weights:
        weight = F.coalesce(F.try_element_at(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))]), F.col("mix_source")), weight)
    # the rows of a source follow a hash, whatever their number; parts are ranges of it
    hashable = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_own"),
        F.coalesce(F.col(source_col).cast("string"), F.lit(_NULL)).alias("mix_source"),
        F.col(id_col).alias("mix_id"), F.xxhash64(F.col(id_col)).alias("mix_hash"), F.xxhash64(*hashable).alias("mix_rest"))
    spread = F.when(F.col("mix_id").isNull(), F.col("mix_rest")).otherwise(F.col("mix_hash"))
    keyed = keyed.withColumn("mix_hash", F.shiftrightunsigned(spread, 32)).withColumn("mix_part", F.shiftright(F.col("mix_hash") * parts, 32))
    counts = keyed.groupBy("mix_source", "mix_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("mix_source").orderBy("mix_part").rowsBetween(Window.unboundedPreceding, -1)
    sources = counts.groupBy("mix_source").agg(F.sum("n").alias("rows"))
    sources = sources.select("mix_source", weight.cast("bigint").alias("w"), F.expr(f"(rows + {block_rows - 1}) div {block_rows}").alias("blocks"))

    # one row: all sources in order, and the rounds at which the kind of round changes
    one = sources.agg(F.array_sort(F.collect_list(F.struct("mix_source", "w", "blocks"))).alias("all"))
    one = one.withColumn("turns", F.expr("array_sort(array_distinct(flatten(array(array(0L), transform(all, s -> s.blocks div s.w), transform(all, s -> s.blocks div s.w + 1)))))"))
    kinds = one.select("all", F.posexplode("turns").alias("kind", "turn"))
    kinds = kinds.withColumn("share", F.expr("transform(all, s -> greatest(0L, least(s.w, s.blocks - turn * s.w)))"))
    kinds = kinds.withColumn("total", F.expr("aggregate(share, 0L, (a, x) -> a + x)")).filter("total > 0")
    kinds = kinds.withColumn("base", F.expr("aggregate(all, 0L, (a, s) -> a + least(s.blocks, turn * s.w))"))
    kinds = kinds.repartition("kind")  # a task for each: their schedules do not depend on one another
    slots = kinds.select("all", "kind", "turn", "total", "base", F.posexplode(F.expr(_SCHEDULE)).alias("slot", "i"))
    nth = Window.partitionBy("kind", "i").orderBy("slot")
    slots = slots.select("kind", F.expr("all[i].mix_source").alias("mix_source"), "turn", "total", "base", "slot", (F.row_number().over(nth) - 1).cast("bigint").alias("k"))

    per_source = one.select("turns", F.explode("all").alias("s")).select("s.mix_source", "s.w", "turns")
    offsets = counts.withColumn("mix_before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n").join(per_source, "mix_source")
    own = Window.partitionBy("mix_source", "mix_part").orderBy("mix_hash", "mix_id", "mix_rest")
    ranked = keyed.withColumn("mix_index", F.row_number().over(own) - 1).join(offsets, ["mix_source", "mix_part"])
    ranked = ranked.withColumn("mix_index", F.col("mix_index") + F.col("mix_before"))
    ranked = ranked.withColumns({"mix_block": F.expr(f"mix_index div {block_rows}"), "mix_row": F.expr(f"cast(mix_index % {block_rows} as int)")})
    ranked = ranked.withColumns({"mix_round": F.expr("mix_block div w"), "k": F.expr("mix_block % w")})
    ranked = ranked.withColumn("kind", F.expr("size(filter(turns, x -> x <= mix_round)) - 1")).drop("turns")
    placed = ranked.join(slots, ["kind", "mix_source", "k"])
    kept = [F.col("mix_own").getField(c).alias(c) for c in docs.columns if c.lower() not in ("mix_slot", "mix_row", "mix_block")]
    return placed.withColumn("mix_slot", F.expr("base + (mix_round - turn) * total + slot")).select(*kept, "mix_slot", "mix_row", "mix_block")


def target_weights() -> dict[str, int]:
    """The production mixture: src0, src5, ... weigh 1, src1, src6, ... 2, up to 5."""
    return {f"src{k}": k % 5 + 1 for k in range(20)}


def op9_source_mixing(spark, sf_dir: str) -> DataFrame:
    """A row for each document: its source, slot, place in the block, and the block's number."""
    from quarry.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return schedule(docs, target_weights())

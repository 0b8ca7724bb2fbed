"""Deterministic stratified sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.functions.expressions import fnv1a


def stratified(files: DataFrame, n: int, stratum: str = "category", key: str = "id") -> DataFrame:
    """``n`` of the rows: one of each stratum if there are no more strata than that, the rest in
    proportion to what is left of each, by largest remainder, larger strata first; within a
    stratum those of least key hash. All rows if there are no more."""
    if n < 1:
        raise ValueError("a sample has one row at least")
    sizes = files.groupBy(stratum).agg(F.count("*").alias("size"))
    every = Window.partitionBy(F.lit(0))  # a row for each stratum
    k = sizes.withColumns({"total": F.sum("size").over(every), "strata": F.count("*").over(every)})
    k = k.withColumn("base", (F.col("strata") <= n).cast("int"))
    k = k.withColumns({"spare": n - F.col("base") * F.col("strata"), "open": F.col("total") - F.col("base") * F.col("strata")})
    k = k.withColumn("share", F.when(F.col("open") > 0, F.col("spare") * (F.col("size") - F.col("base")) / F.col("open").cast("double")).otherwise(0.0))
    order = every.orderBy(F.desc(F.col("share") - F.floor("share")), F.desc("size"), stratum)
    k = k.withColumns({"place": F.row_number().over(order), "given": F.sum(F.floor("share")).over(every)})
    take = F.when(F.col("total") <= n, F.col("size")).otherwise(F.col("base") + F.floor("share") + (F.col("place") <= F.col("spare") - F.col("given")).cast("int"))
    within = Window.partitionBy(stratum).orderBy("hash_", key)
    own = files.withColumn("hash_", fnv1a(F.col(key)))
    ranked = own.withColumn("place_", F.row_number().over(within)).filter(F.col("place_") <= n)  # a group limit before the shuffle
    return ranked.join(k.select(stratum, take.alias("take_")), stratum).filter("place_ <= take_").select(*files.columns)

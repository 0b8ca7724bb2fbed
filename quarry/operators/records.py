"""Tables of records with constraints: documents, search logs, feedback. Parquet has no keys, so
what a database would refuse is worked out as joins before rows are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.operators.store import latest

#: Ranks of a result that feedback may name.
MOST_RANK = 20
FEEDBACK_KEY = ("user_id", "log_id", "document_id")


def valid_feedback() -> Column:
    """Whether a row may be stored at all: ids, a rank of 1 to 20, a finite score, known words."""
    named = [F.coalesce(F.col(c) != "", F.lit(False)) for c in ("log_id", "document_id", "chunk_id")]
    finite = F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf"))
    out = F.col("rank").between(1, MOST_RANK) & finite & F.col("feedback").isin("positive", "negative") & F.col("source").isin("web", "slack")
    for one in named:
        out = out & one
    return F.coalesce(out, F.lit(False))


def accepted_feedback(rows: DataFrame, stored: DataFrame, logs: DataFrame) -> DataFrame:
    """The rows that may be appended: valid, of a search (logs: log_id, user_id) of the same user, and
    the first, by ordinal, for a user, search and document that none is stored for."""
    owned = rows.filter(valid_feedback()).join(logs.select("log_id", "user_id"), ["log_id", "user_id"], "left_semi")
    new = owned.join(stored.select(*FEEDBACK_KEY), list(FEEDBACK_KEY), "left_anti")
    first = Window.partitionBy(*FEEDBACK_KEY).orderBy("ordinal")
    return new.withColumn("n_", F.row_number().over(first)).filter("n_ = 1").select(*rows.columns)


def logged(searches: DataFrame, found: DataFrame, key: str = "request_id") -> DataFrame:
    """Log rows of searches (request_id, user_id, source, query) with the number of their results
    (found: a row for each) and an id that is the same if the rows are made again."""
    counts = found.groupBy(key).agg(F.count("*").alias("result_count"))
    id_ = F.sha2(F.concat_ws("\0", F.col(key).cast("string"), F.col("user_id").cast("string"), "query"), 256)
    out = searches.join(counts, key, "left").withColumn("result_count", F.coalesce("result_count", F.lit(0)))
    return out.withColumn("id", F.concat(F.lit("log-"), F.left(id_, F.lit(16))))


def upserted_documents(stored: DataFrame, updates: DataFrame, key: str = "drive_file_id", order: str | None = None) -> DataFrame:
    """``stored`` (id, key, ...) with the values of ``updates`` (key, ...) where it has the key, and new
    rows for other keys. The id of a row never changes; a new one follows from its key. Of updates with
    one key the last by ``order`` counts; without an order they are an error."""
    updates = latest(updates, key, order)
    names = [c for c in stored.columns if c not in ("id", key) and c in updates.columns]
    new = updates.select(key, *[F.col(c).alias(f"new_{k}_") for k, c in enumerate(names)], F.lit(True).alias("given_"))
    joined = stored.join(new, key, "full_outer")
    own = F.coalesce("id", F.concat(F.lit("doc-"), F.left(F.sha2(F.col(key), 256), F.lit(16))))
    value = {c: F.when(F.col("given_"), F.col(f"new_{k}_")).otherwise(F.col(c)).alias(c) for k, c in enumerate(names)}
    return joined.select(*[own.alias("id") if c == "id" else value.get(c, F.col(c)) for c in stored.columns])


def with_states(stored: DataFrame, changes: DataFrame) -> DataFrame:
    """``stored`` with is_indexed, duplicate_of and is_active of ``changes`` (id, ...) where it has them."""
    names = ("is_indexed", "duplicate_of", "is_active")
    joined = stored.join(changes.select("id", *[F.col(c).alias(f"{c}_new_") for c in names], F.lit(True).alias("given_")), "id", "left")
    return joined.select(*[F.when(F.col("given_"), F.col(f"{c}_new_")).otherwise(F.col(c)).alias(c) if c in names else F.col(c) for c in stored.columns])


def violations(table: DataFrame, unique: list[list[str]] = (), checks: dict[str, Column] | None = None, parents: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(rule, rows): how many rows break each rule: a key that is there twice, a check that is false,
    a column without its row in a parent table. Nulls break no rule."""
    found = []
    for names in unique:
        twice = table.dropna(subset=names).groupBy(*names).count().filter("count > 1").agg(F.coalesce(F.sum("count"), F.lit(0)).alias("rows"))
        found.append(twice.select(F.lit(f"unique {', '.join(names)}").alias("rule"), "rows"))
    for name, ok in (checks or {}).items():
        found.append(table.filter(~ok).agg(F.count("*").alias("rows")).select(F.lit(f"check {name}").alias("rule"), "rows"))
    for name, (parent, key) in (parents or {}).items():
        lost = table.filter(F.col(name).isNotNull()).join(parent.select(F.col(key).alias(name)).distinct(), name, "left_anti")
        found.append(lost.agg(F.count("*").alias("rows")).select(F.lit(f"parent of {name}").alias("rule"), "rows"))
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out


def action_value(log: Column, document: Column, chunk: Column, rank: Column, score: Column, feedback: Column) -> Column:
    """A feedback button's value as JSON."""
    return F.to_json(F.struct(log.alias("searchLogId"), document.alias("documentId"), chunk.alias("chunkId"), rank.alias("rank"), score.alias("score"), feedback.alias("feedback")))


def read_action(value: Column) -> Column:
    """The fields of such a value, null where one is missing or wrong."""
    x = F.from_json(value, "searchLogId string, documentId string, chunkId string, rank int, score double, feedback string")
    ok = (x["searchLogId"] != "") & (x["documentId"] != "") & (x["chunkId"] != "") & (x["rank"] >= 1) & ~F.isnan(x["score"]) & x["feedback"].isin("positive", "negative")
    return F.when(F.coalesce(ok, F.lit(False)), x)


def direct_messages(messages: DataFrame) -> DataFrame:
    """(user_id, query) of messages (channel_type, subtype, bot_id, user, text) that a person sent to
    the bot alone."""
    kept = (F.col("channel_type") == "im") & F.col("subtype").isNull() & F.col("bot_id").isNull() & (F.col("user") != "") & F.col("text").isNotNull()
    return messages.filter(kept).withColumns({"user_id": F.col("user"), "query": F.trim("text")})

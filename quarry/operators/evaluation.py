"""Relevance evaluation: a data set's checks, metrics of each case, and their summary."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GRADES = (0, 1, 2, 3)
#: Items too short for a seed that one reading of the texts looks for.
SHORT_ITEMS = 1000


def _text(value: object) -> bool:
    return isinstance(value, str) and bool(value.strip())


def _grade(value: object) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value in GRADES


def checked_dataset(data: dict) -> dict:
    """A data set as it was read from JSON; the first fault found is a ``ValueError``."""

    def need(ok: bool, what: str) -> None:
        if not ok:
            raise ValueError(what)

    need(isinstance(data, dict), "a data set is an object")
    version, threshold = data.get("version"), data.get("relevantThreshold")
    need(isinstance(version, int) and not isinstance(version, bool) and version >= 1, "version is a positive integer")
    need(_text(data.get("description")), "description is missing")
    need(_grade(threshold), "relevantThreshold is a grade of 0 to 3")
    scale = data.get("relevanceScale")
    need(isinstance(scale, dict) and all(isinstance(x, str) for x in scale.values()), "relevanceScale maps grades to texts")
    cases = data.get("cases")
    need(isinstance(cases, list) and bool(cases), "a data set has a case at least")
    seen = set()
    for case in cases:
        need(isinstance(case, dict) and all(_text(case.get(k)) for k in ("id", "query", "category")), "a case has id, query and category")
        name = case["id"]
        need(name not in seen, f"case {name} is there twice")
        seen.add(name)
        judgments = case.get("judgments")
        need(isinstance(judgments, list) and isinstance(case.get("note", ""), str), f"case {name} has no judgments")
        documents = set()
        for judgment in judgments:
            need(isinstance(judgment, dict) and _text(judgment.get("documentName")), f"case {name}: a judgment names a document")
            document = unicodedata.normalize("NFC", judgment["documentName"])
            need(document not in documents, f"case {name} judges {document} twice")
            documents.add(document)
            need(_grade(judgment.get("relevance")) and isinstance(judgment.get("rationale", ""), str), f"case {name}: relevance is a grade of 0 to 3")
            need(not (case.get("noAnswer") is True and judgment["relevance"] >= threshold), f"case {name} has no answer, yet a relevant document")
    return data


def chosen_cases(dataset: dict, case: str | None = None, category: str | None = None) -> list[dict]:
    """The cases with this id and of this category, where given; none is an error."""
    out = [c for c in dataset["cases"] if case in (None, c["id"]) and category in (None, c["category"])]
    if not out:
        raise ValueError(f"no case {case or '*'} of category {category or '*'}")
    return out


def gain(grade: Column, rank: Column) -> Column:
    return (F.pow(F.lit(2.0), grade) - 1) / F.log2(rank + 1)


def evaluate(cases: DataFrame, judgments: DataFrame, results: DataFrame, limit: int, threshold: int = 2) -> DataFrame:
    """Metrics of each of ``cases`` (case_id, no_answer) at ``limit``.

    ``judgments`` (case_id, document, grade) holds a document once for each case; ``results`` is
    (case_id, document, score, rank from 1). All joins are on the case; only ranks up to
    ``limit`` and judged documents are shuffled. hit, mrr and ndcg are null without an answer.
    """
    if limit < 1:
        raise ValueError("a limit is a positive integer")
    ideal_rank = F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("grade"), "document"))
    ideal = judgments.withColumn("n", ideal_rank).groupBy("case_id").agg(
        F.sum(F.when(F.col("n") <= limit, gain(F.col("grade"), F.col("n")))).alias("ideal"), F.count_if(F.col("grade") >= threshold).alias("judged_relevant"))
    top = results.filter(F.col("rank") <= limit).join(judgments.select("case_id", "document", "grade"), ["case_id", "document"], "left")
    grade = F.coalesce("grade", F.lit(0))
    found = top.groupBy("case_id").agg(
        F.min(F.when(grade >= threshold, F.col("rank"))).alias("first"), F.sum(gain(grade, F.col("rank"))).alias("dcg"),
        F.count_if(F.col("grade").isNull()).alias("unjudged"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("top_score"))
    out = cases.select("case_id", "no_answer").join(ideal, "case_id", "left").join(found, "case_id", "left")
    answered = ~F.col("no_answer")
    return out.select(
        "case_id", "no_answer",
        F.when(answered, F.col("first").isNotNull().cast("double")).alias("hit"),
        F.when(answered, F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        F.when(answered, F.when(F.coalesce("ideal", F.lit(0.0)) > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0)).alias("ndcg"),
        F.coalesce("dcg", F.lit(0.0)).alias("dcg"), "top_score",
        F.coalesce("judged_relevant", F.lit(0)).alias("judged_relevant"), F.coalesce("unjudged", F.lit(0)).alias("unjudged"))


def summary(metrics: DataFrame) -> DataFrame:
    """One row over the metrics of all cases."""
    silent = F.when(F.col("no_answer"), F.col("top_score"))
    means = [F.avg(m).alias(m) for m in ("hit", "mrr", "ndcg")]
    return metrics.agg(F.count("*").alias("cases"), F.count_if(~F.col("no_answer")).alias("answered"), F.count_if("no_answer").alias("no_answer"), *means, F.avg(silent).alias("mean_silent_score"), F.max(silent).alias("max_silent_score"))


def containing(documents: DataFrame, items: DataFrame, seed: int = 5) -> DataFrame:
    """(item_id, doc_id) of every document whose text contains an item's text.

    Candidates share the item's whole words from its second on, ``seed`` of them or as many as
    there are before its last: an equi-join on their hash, after which each candidate is held
    against the text. Items of fewer than three words have no such seed: the texts are read once for
    each list of ``SHORT_ITEMS`` of them. Null texts match nothing."""
    words = "filter(split(text, '[ \\t\\n\\r\\f]+'), w -> w <> '')"
    split = items.filter("text IS NOT NULL").select("item_id", F.col("text").alias("item"), F.expr(words).alias("w"))
    size = F.least(F.lit(seed), F.size("w") - 2)
    seeds = split.filter(size > 0).select("item_id", size.alias("n"), F.xxhash64(F.slice("w", F.lit(2), size)).alias("key"))
    body = documents.filter("text IS NOT NULL").select("doc_id", F.expr(words).alias("w"))
    short = split.filter(size <= 0).select("item_id", "item").collect()
    keys = []
    for row in sorted(seeds.select("n").distinct().collect()):  # ``seed`` rows at most
        n = row["n"]
        shingles = F.expr(f"explode(array_distinct(transform(sequence(1, size(w) - {n} + 1), i -> xxhash64(slice(w, i, {n})))))")
        keys.append(body.filter(F.size("w") >= n).select("doc_id", F.lit(n).alias("n"), shingles.alias("key")))
    out = []
    if keys:
        pairs = reduce(DataFrame.unionAll, keys).join(seeds, ["n", "key"]).select("item_id", "doc_id").distinct()
        near = pairs.join(split.select("item_id", "item"), "item_id").join(documents.select("doc_id", "text"), "doc_id")
        out.append(near.filter(F.contains("text", "item")).select("item_id", "doc_id"))
    for at in range(0, len(short), SHORT_ITEMS):
        listed = F.array(*[F.struct(F.lit(r["item_id"]).alias("item_id"), F.lit(r["item"]).alias("item")) for r in short[at : at + SHORT_ITEMS]])
        direct = documents.select("doc_id", F.explode(F.filter(listed, lambda x: F.contains(F.col("text"), x["item"]))).alias("hit"))
        out.append(direct.select("hit.item_id", "doc_id"))
    return reduce(DataFrame.unionAll, out) if out else split.select("item_id", F.lit(None).cast("long").alias("doc_id")).limit(0)

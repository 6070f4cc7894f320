"""Outcomes of a comparison over a corpus: classes, bands, percentiles, clusters, rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = (0.75, 0.95, 0.98, 0.99)
PERCENTILES = (0.5, 0.75, 0.9, 0.95, 0.99)


def classify(ours: Column, theirs: Column, sim: Column, ours_late: Column | None = None, theirs_late: Column | None = None) -> Column:
    """Outcome of a full outer join of results: who has no result, then whose text is empty, then how near the texts are.

    A null text is a refusal, or a timeout where the late flag of its side is set; if both sides have none, both reject.
    """
    late = [F.lit(False) if x is None else F.coalesce(x, F.lit(False)) for x in (ours_late, theirs_late)]
    return (
        F.when(ours.isNull() & theirs.isNull(), "both-reject").when(ours.isNull(), F.when(late[0], "ours-timeout").otherwise("ours-rejects")).when(theirs.isNull(), F.when(late[1], "theirs-timeout").otherwise("theirs-rejects"))
        .when((ours == "") & (theirs == ""), "empty-both").when(ours == "", "empty-ours").when(theirs == "", "empty-theirs")
        .when(sim >= 0.99, "match").when(sim >= 0.95, "diff<5").when(sim >= 0.75, "diff<25").otherwise("diff>=25")
    )


def bands(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count(value).alias("n"), *[F.count_if(F.col(value) >= b).alias(f"at_{round(b * 100)}") for b in BANDS])


def percentiles(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Nearest-rank percentiles, mean and maximum, rounded to two places."""
    ranks = [F.round(F.expr(f"percentile_disc({p}) within group (order by {value})"), 2).alias(f"p{round(p * 100)}") for p in PERCENTILES]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 2).alias("mean"), *ranks, F.round(F.max(value), 2).alias("most"))


def clusters(rows: DataFrame, signature: str, key: str, weight: Column) -> DataFrame:
    """Rows, distinct keys, their weights and three smallest keys of each signature."""
    per_key = rows.groupBy(signature, key).agg(F.count("*").alias("c"), F.max(weight).alias("w"))
    sums = per_key.groupBy(signature).agg(F.sum("c").alias("outcomes"), F.count("*").alias("files"), F.sum("w").alias("weighted"))
    # ranks are cut before the shuffle, so no group is gathered
    rank = F.row_number().over(Window.partitionBy(signature).orderBy(key))
    first = per_key.withColumn("rank", rank).where("rank <= 3").groupBy(signature).agg(F.array_join(F.sort_array(F.collect_list(key)).cast("array<string>"), ",").alias("examples"))
    return sums.join(first, signature)


def evaluate(documents: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule, outcome): pass, fail, or unevaluated where a rule's condition is null. One pass, no join with the rules."""
    outcome = [F.struct(F.lit(n).alias("rule"), F.when(c.isNull(), "unevaluated").when(c, "pass").otherwise("fail").alias("outcome")) for n, c in rules.items()]
    return documents.select(key, F.inline(F.array(*outcome)))


#: Fixed value: severities from the least to the worst.
SEVERITIES = ("ok", "notice", "warn")


def worst_severity(rows: DataFrame, by: list[str], severity: str) -> DataFrame:
    """The worst severity of each group; what is no severity counts as ok."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), F.col(severity)), F.lit(0))
    return rows.groupBy(*by).agg(F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.greatest(F.max(rank), F.lit(1)).cast("int")).alias("worst"))


def ranked_names(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """Names of each group, how often they occur and their place: the most frequent first, then by name."""
    counts = rows.groupBy(*by, name).agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), name)).cast("long"))


def corpus_weight(path: Column) -> Column:
    """What a file counts: files from the wild count three times."""
    return F.when(path.contains("govdocs") | path.contains("wild"), 3).otherwise(1)

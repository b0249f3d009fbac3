"""Matching source columns to target fields: pre-filter, judging, votes, resolution.

Models are plug-ins (`models.py`). Whatever they are asked is asked once per
different input and joined back; orders that decide ties are explicit columns.
Empty inputs give empty outputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reviewloom.common import maybe_broadcast
from reviewloom.functions import rules as R
from reviewloom.functions.similarity import cosine, name_ratio, norm


def first_by(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row of each key."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def pair_table(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Every source column beside every target field (a dozen rows, checked before a broadcast)."""
    return sources.crossJoin(maybe_broadcast(targets))


def samples(values: DataFrame, keys: list[str], value: str, n: int = 3, seed: str = "42") -> DataFrame:
    """N different values per key in the order of their hash; sample_1 .. sample_n.

    Only different values are sorted, and the n smallest are kept as they merge.
    """
    v = values.where(F.col(value).isNotNull()).select(*keys, value).distinct()
    w = W.partitionBy(*keys).orderBy(F.md5(F.concat(F.lit(seed), F.col(value))), value)
    v = v.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
    return v.groupBy(*keys).agg(*[F.max(F.when(F.col("place") == i, F.col(value))).alias(f"sample_{i}") for i in range(1, n + 1)])


def prefilter(sources: DataFrame, targets: DataFrame, k: int = 5, threshold: float = 0.25) -> DataFrame:
    """Per source the k most similar targets at or above the threshold.

    sources: source_column, v1, v2, v3 (one vector per description); targets:
    target_column, v. Similarity is the best of the three descriptions, rounded
    to four places; ties go to the earlier description and target name.
    """
    s = sources.withColumns({f"n{i}": norm(F.col(f"v{i}")) for i in (1, 2, 3)})
    t = targets.withColumn("n", norm(F.col("v")))
    sims = F.array(*[F.coalesce(cosine(F.col(f"v{i}"), F.col("v"), F.col(f"n{i}"), F.col("n")), F.lit(-1.0)) for i in (1, 2, 3)])
    x = s.crossJoin(maybe_broadcast(t)).select("source_column", "target_column", sims.alias("sims"))
    x = x.withColumns({"best": F.array_max("sims"), "best_description_num": F.array_position("sims", F.array_max("sims")).cast("int")})
    w = W.partitionBy("source_column").orderBy(F.desc(F.round("best", 9)), "target_column")
    x = x.withColumn("place", F.row_number().over(w)).where((F.col("place") <= k) & (F.col("best") >= threshold))
    return x.select("source_column", "target_column", F.round("best", 4).alias("similarity_score"), "best_description_num")


def expand(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """The candidates' rows of the full pair table, best similarity first."""
    c = first_by(candidates, ["source_column", "target_column"], F.desc("similarity_score"))
    return pairs.join(c, ["source_column", "target_column"])


def vote(a: Column, b: Column, c: Column) -> Column:
    """The majority of three; all different gives Yes."""
    return F.when((a == b) | (a == c), a).when(b == c, b).otherwise("Yes")


def voted(judged: DataFrame) -> DataFrame:
    """Final answer, whether unanimous, how many agree with it."""
    o = [F.col(f"output_{i}") for i in (1, 2, 3)]
    x = judged.withColumn("processed_output", vote(*o))
    agree = sum((c == F.col("processed_output")).cast("int") for c in o[1:]) + (o[0] == F.col("processed_output")).cast("int")
    return x.withColumns({"unanimous": (o[0] == o[1]) & (o[1] == o[2]), "agreement_level": agree})


def voting_summary(v: DataFrame) -> DataFrame:
    """Totals of unanimous, at least two, split."""
    n = F.count("*")
    pct = lambda c: F.round(F.coalesce(100.0 * c / F.nullif(n, F.lit(0)), F.lit(0.0)), 4)
    u, two, split = F.count_if("unanimous"), F.count_if(F.col("agreement_level") >= 2), F.count_if(F.col("agreement_level") < 2)
    return v.agg(n.alias("pairs"), u.alias("unanimous"), two.alias("at_least_two"), split.alias("split"), pct(u).alias("pct_unanimous"), pct(two).alias("pct_two"))


# Propagated columns, where they come from, and the text on rows that were not judged.
PROPAGATED = {"prompt": ("prompt", "Not generated (filtered out)"), "raw_output": ("raw_output", "Not processed (filtered out)"), "processed_output": ("output", "Unknown")}


def propagate(pairs: DataFrame, judged: DataFrame) -> DataFrame:
    """The unique pairs' prompts, raw and processed outputs and vote on all rows; unjudged ones say so."""
    key = ["source_column", "target_column"]
    each = {f"{new}_{i}": (f"{old}_{i}", text) for new, (old, text) in PROPAGATED.items() for i in (1, 2, 3)} | {"processed_output": ("processed_output", "Unknown")}
    j = judged.select(*key, *[(F.col(old) if old in judged.columns else F.lit(None).cast("string")).alias(f"_{new}") for new, (old, _) in each.items()])
    x = pairs.drop("similarity_score", *each).join(j, key, "left")
    return x.withColumns({new: F.coalesce(f"_{new}", F.lit(text)) for new, (_, text) in each.items()}).drop(*[f"_{new}" for new in each])


def filter_summary(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows and unique pairs before and after the pre-filter, and the reduction in percent."""
    count = lambda d, a: d.agg(F.count("*").alias(f"{a}_rows"), F.count_distinct(F.struct("source_column", "target_column")).alias(f"{a}_pairs"))
    x = count(pairs, "all").crossJoin(F.broadcast(count(kept, "kept")))  # one row each
    return x.withColumn("reduction_percent", F.round(100.0 * (1 - F.col("kept_pairs") / F.nullif("all_pairs", F.lit(0))), 4))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def resolve(mapping: DataFrame, order: str = "result_order", single: tuple[str, ...] = ("comment_id", "agency", "author")) -> DataFrame:
    """Accepted pairs, one target per source column, one source for single targets.

    F1 keeps Yes; N7 takes the target whose name is most like the column's (first
    wins ties); N6 keeps the first source per file of the single targets.
    """
    yes = mapping.where("confidence = 'Yes'")
    names = yes.select("source_column", "target_column").distinct()
    names = names.withColumn("sim", name_ratio(R.column_name(F.col("source_column")), R.column_name(F.col("target_column"))))
    x = yes.join(names, ["source_column", "target_column"])
    keys = ["source_column", "source_file", "sample_1", "sample_2", "sample_3"]
    x = first_by(x.fillna("", keys[1:]), keys, F.desc("sim"), order)
    is_single = F.col("target_column").isin(*single)
    return x.where(~is_single).unionByName(first_by(x.where(is_single), ["target_column", "source_file"], order))


def fallback(headers: DataFrame) -> DataFrame:
    """Well-known headers, case-sensitive, with confidence Fallback."""
    return headers.withColumn("target_column", R.fallback_target(F.col("source_column"))).where("target_column is not null").withColumn("confidence", F.lit("Fallback"))

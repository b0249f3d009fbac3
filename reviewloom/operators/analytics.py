"""Questions and reports over the normalized review table.

`review` is the typed view all of them start from: empty cells are null, rounds
are numbers, dates are dates, response times are days. Group keys that are null
take part in no group. Ties are broken by key, ascending. Exact medians and
percentiles keep counts per different value, so a group with a third of all
rows stays small in memory; everything aggregates partially before it shuffles.
An empty table gives no groups, and null or 0 for scalars as each query says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reviewloom.common import filled
from reviewloom.functions import rules as R

RT = "response_days"


def review(rows: DataFrame, existing: str = "response_time_days") -> DataFrame:
    """The typed view of normalized rows.

    Response times are whole days between the dates; a number in the column
    `existing`, where the rows have one, is preferred (C18).
    """
    text = ("project", "agency", "author", "status", "comment_type", "comment_id", "section", "topic", "comment_text", "response_text")
    x = rows.select("rec_id", *[filled(F.col(c)).alias(c) for c in text], R.to_number(F.col("round")).alias("round"), *[R.to_date(F.col(c)).alias(c) for c in ("date_received", "date_responded")], *([F.col(existing).cast("string").alias("existing")] if existing in rows.columns else []))
    known = R.to_number(F.col("existing")) if "existing" in x.columns else None
    return x.withColumn(RT, R.whole_days(F.col("date_received"), F.col("date_responded"), known)).drop("existing").withColumn("round_group", R.round_group(F.col("round")))


def top(df: DataFrame, key: str, n: int, count: str = "n") -> DataFrame:
    """The n most frequent values; nulls are not counted."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias(count)).orderBy(F.desc(count), key).limit(n)


def best(df: DataFrame, key: str, value: F.Column, name: str = "value", highest: bool = True) -> DataFrame:
    """The key whose group has the highest (lowest) value; groups without one don't count."""
    g = df.where(F.col(key).isNotNull()).groupBy(key).agg(value.alias(name)).where(F.col(name).isNotNull())
    return g.orderBy(F.desc(name) if highest else F.asc(name), key).limit(1)


def by_round_group(r: DataFrame) -> DataFrame:
    """A1: mean, median and count of response times for 1, 2, 3+; a missing group has nulls and 0."""
    groups = r.sparkSession.createDataFrame([("1", 1), ("2", 2), ("3+", 3)], "round_group string, ord int")
    g = r.where(F.col("round_group").isNotNull()).groupBy("round_group").agg(F.avg(RT).alias("mean_days"), F.median(RT).alias("median_days"), F.count(RT).alias("n"))
    return groups.join(g, "round_group", "left").select("round_group", F.round("mean_days", 6).alias("mean_days"), F.round("median_days", 6).alias("median_days"), F.coalesce("n", F.lit(0)).alias("n"))


def agency_rounds(r: DataFrame, n: int = 6) -> DataFrame:
    """Counts by agency (the top n, others as Other) and round group, and cumulative over rounds."""
    names = top(r, "agency", n).select(F.col("agency").alias("a"))
    x = r.where(F.col("round_group").isNotNull()).join(F.broadcast(names), F.col("agency") == F.col("a"), "left")  # n rows
    x = x.groupBy(F.coalesce("a", F.lit("Other")).alias("agency_plot")).pivot("round_group", ["1", "2", "3+"]).agg(F.count(F.lit(1))).na.fill(0)
    one, two, three = F.col("1"), F.col("2"), F.col("3+")
    return x.select("agency_plot", one.alias("r1"), two.alias("r2"), three.alias("r3plus"), (one + two).alias("c2"), (one + two + three).alias("c3plus"))


def pies(rounds: DataFrame) -> DataFrame:
    """A5: each agency's share of a pie in percent, labelled from 6 percent on."""
    x = rounds.select("agency_plot", F.expr("stack(3, '1', r1, '2', c2, '3+', c3plus) AS (pie, n)"))
    share = 100.0 * F.col("n") / F.nullif(F.sum("n").over(W.partitionBy("pie")), F.lit(0))
    return x.withColumn("percent", F.round(share, 4)).withColumn("labelled", F.coalesce(share >= 6, F.lit(False)))


def ecdf(r: DataFrame) -> DataFrame:
    """One point (value, i/n) per observation of each agency and round group.

    Equal values are counted first, so that running sums see different values
    only and the points are spread out again without sorting all rows.
    """
    k = ["agency", "round_group"]
    g = r.where(F.col("agency").isNotNull() & F.col("round_group").isNotNull() & F.col(RT).isNotNull()).groupBy(*k, RT).agg(F.count("*").alias("m"))
    upto = F.sum("m").over(W.partitionBy(*k).orderBy(RT))
    g = g.withColumns({"hi": upto, "n": F.sum("m").over(W.partitionBy(*k))})
    return g.select(*k, RT, "n", F.explode(F.sequence(F.col("hi") - F.col("m") + 1, F.col("hi"))).alias("i")).select(*k, F.col(RT), F.col("i"), F.round(F.col("i") / F.col("n"), 9).alias("y"))


def share_of_total(r: DataFrame) -> DataFrame:
    """Each (project, agency)'s share of its project's rows that name an agency."""
    g = r.where("project is not null and agency is not null").groupBy("project", "agency").agg(F.count("*").alias("n"))
    return g.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("project")))


def coverage(r: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Share of filled cells in percent per column."""
    one = r.agg(F.count("*").alias("rows"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["rows"], list(columns), "column_name", "filled").select("column_name", "filled", F.round(F.coalesce(100.0 * F.col("filled") / F.nullif("rows", F.lit(0)), F.lit(0.0)), 4).alias("percent"))


def progression(r: DataFrame) -> DataFrame:
    """Of the comments with a round 1, how many reach rounds 2 and 3."""
    g = r.where("project is not null and comment_id is not null").groupBy("project", "comment_id").agg(*[F.max((F.col("round") == k).cast("int")).alias(f"r{k}") for k in (1, 2, 3)]).where("r1 = 1")
    pct = lambda c: F.round(F.coalesce(100.0 * F.sum(c) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4)
    return g.agg(F.count("*").alias("with_r1"), F.coalesce(F.sum("r2"), F.lit(0)).alias("with_r2"), F.coalesce(F.sum("r3"), F.lit(0)).alias("with_r3"), pct("r2").alias("pct_r2"), pct("r3").alias("pct_r3"))


def approval_time(r: DataFrame) -> DataFrame:
    """Days from the first receipt to the last answer per project, also as years, months and days."""
    g = r.where("project is not null").groupBy("project").agg(F.datediff(F.max("date_responded"), F.min("date_received")).alias("days")).where("days is not null")
    d = F.col("days")
    return g.withColumn("approval", F.format_string("%dy %dm %dd", F.floor(d / 365), F.floor((d % 365) / 30), (d % 365) % 30))


def project_report(r: DataFrame) -> DataFrame:
    """Rows and share per project, its highest round and rows per round."""
    g = r.where("project is not null").groupBy("project").agg(F.count("*").alias("n"), F.max("round").alias("max_round"), *[F.count_if(F.col("round") == k).alias(f"n_r{k}") for k in (1, 2, 3)])
    return g.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), 4))


def sane(r: DataFrame, most: float = 5000) -> DataFrame:
    """F8: answered rows, which have a day of the answer, with a response time of 0 to `most` days."""
    return r.where(F.col("date_responded").isNotNull() & F.col(RT).between(0, most))


def quality(r: DataFrame) -> DataFrame:
    """rows that miss a required or recommended column, a date year or a comment length rule."""
    from reviewloom import rulesdata as D

    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    year, size = F.year("date_received"), F.length("comment_text")
    return r.agg(
        *[n(F.col(c).isNull()).alias(f"missing_{c}") for c in (*D.REQUIRED, *D.RECOMMENDED)],
        n(~year.between(*D.YEARS)).alias("bad_year"), n(~size.between(*D.COMMENT_LENGTH)).alias("bad_length"),
    )


QUESTIONS = {
    "g01_round1_count": lambda r: r.agg(F.count_if(F.col("round") == 1).alias("answer")),
    "g02_most_common_agency": lambda r: top(r, "agency", 1).select("agency"),
    "g03_round_with_most_rows": lambda r: top(r, "round", 1).select("round"),
    "g04_most_common_agency_rows": lambda r: top(r, "agency", 1).select("n"),
    "g05_unanswered_count": lambda r: r.agg(F.count_if(F.col("date_responded").isNull()).alias("answer")),
    "g06_median_days_round2": lambda r: r.where("round = 2").agg(F.round(F.median(RT), 2).alias("answer")),
    "g07_agency_lowest_median": lambda r: best(r, "agency", F.median(RT), highest=False).select("agency"),
    "g08_share_within_30_round2": lambda r: r.where(f"round = 2 and {RT} is not null").agg(F.round(F.coalesce(F.avg((F.col(RT) <= 30).cast("double")) * 100, F.lit(0.0)), 2).alias("answer")),
    "g09_round1_top_agency": lambda r: top(r.where("round = 1"), "agency", 1).select("agency"),
    "g10_agency_highest_unanswered": lambda r: best(r, "agency", F.avg(F.col("date_responded").isNull().cast("double"))).select("agency"),
    "g11_agency_highest_p90": lambda r: best(r, "agency", F.percentile(RT, 0.9)).select("agency", F.round("value", 6).alias("p90")),
    "g12_unanswered_last_90_days": lambda r: r.where("date_responded is null").crossJoin(F.broadcast(r.agg(F.max("date_received").alias("latest")))).agg(F.count_if(F.col("date_received") >= F.date_sub("latest", 90)).alias("answer")),
    "g13_project_highest_median": lambda r: best(r, "project", F.median(RT)).select("project"),
    "g14_agency_largest_increase": lambda r: best(
        r.where(R.round_label(F.col("round")) != "other"), "agency",
        F.avg(F.when(F.col("round") >= 3, F.col(RT))) - F.avg(F.when(F.col("round") == 1, F.col(RT))),
    ).select("agency"),
    "g15_top_pair_share": lambda r: share_of_total(r).orderBy(F.desc("share"), "project", "agency").limit(1).select(F.format_string("%s | %s | share=%.4f", "project", "agency", "share").alias("answer")),
}

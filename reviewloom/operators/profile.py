"""Column-level data quality: declared constraints, one shared aggregate, control limits.

A `Constraint` declares what a filled cell of a column must satisfy. All
constraints of all columns compile into one aggregate over the table whose
rows are *states* (load, column, value -> counts); states of two partitions or
of two runs merge by adding. A `Store` keeps them, a folder for each load, so a
new load needs only its own scan. States hold every different value, which suits
columns of few values; for ids and texts `sketch_states` hold sketches of bounded
size that merge as well.

Metrics per load are derived from the states. Findings are metrics beyond a
control limit: a declared distance from the centre of all loads (`Limit`), or a
number of robust deviations from the loads before (`history`).

Nulls, blanks and placeholders are empty cells, never faulty. An empty table
gives empty results. Other columns of the table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from reviewloom.common import filled, is_empty, shared_folder, short_list


@dataclass(frozen=True)
class Constraint:
    """A column's format and range; each is a rule on a filled string cell."""

    column: str
    passes: callable
    in_range: callable | None = None
    by_value_distribution: bool = False
    by_constant: bool = False


def _date(c: Column) -> Column:
    return F.when(c.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.try_to_date(c, "yyyy-MM-dd"))


# The checks on the four profiled columns.
REVIEW_CONSTRAINTS = (
    Constraint("round", lambda c: c.rlike(r"\A[0-9]+\z"), lambda c: c.rlike(r"\A0*([1-9]|1[0-2])\z"), by_value_distribution=True),
    Constraint("date_received", lambda c: _date(c).isNotNull(), lambda c: F.year(_date(c)).between(2000, 2030), by_constant=True),
    Constraint("status", lambda c: c.rlike(r"\p{L}") & ~c.rlike(r"[\p{Nd}#]"), by_value_distribution=True),
    Constraint("source_file", lambda c: c.rlike(r"\A[a-z0-9_]+_[0-9]{6}\.xlsx\z")),
)


def verdict(k: Constraint, c: Column) -> Column:
    """'pattern', 'range' or null for one cell; an empty cell is null."""
    ok = F.coalesce(k.passes(c), F.lit(False))
    v = F.when(~ok, F.lit("pattern"))
    if k.in_range:
        v = v.when(~F.coalesce(k.in_range(c), F.lit(False)), F.lit("range"))
    return F.when(~is_empty(c), v)


def cell_findings(df: DataFrame, key: str = "rec_id", constraints=REVIEW_CONSTRAINTS) -> DataFrame:
    """(finding, column_name, case_key): one row for each faulty cell; map-only."""
    cells = F.array(*[F.struct(verdict(k, F.col(k.column)).alias("finding"), F.lit(k.column).alias("column_name")) for k in constraints])
    return (
        df.select(F.col(key).alias("case_key"), F.explode(F.filter(cells, lambda x: x.finding.isNotNull())).alias("c"))
        .select("c.finding", "c.column_name", F.col("case_key").cast("bigint"))
    )


def states(df: DataFrame, load: str = "load_no", constraints=REVIEW_CONSTRAINTS) -> DataFrame:
    """The shared scan: (load_no, column_name, value, n, n_pattern, n_range).

    Empty cells have value null. Partial aggregation runs before the shuffle, so
    a load or value with a third of the rows costs one row per map task.
    """
    cells = F.array(*[
        F.struct(F.lit(k.column).alias("column_name"), F.when(~is_empty(F.col(k.column)), F.col(k.column)).alias("value"), verdict(k, F.col(k.column)).alias("finding"))
        for k in constraints
    ])
    return (
        df.select(F.col(load).alias("load_no"), F.explode(cells).alias("c"))
        .groupBy("load_no", "c.column_name", "c.value")
        .agg(F.count("*").alias("n"), F.count_if(F.col("c.finding") == "pattern").alias("n_pattern"), F.count_if(F.col("c.finding") == "range").alias("n_range"))
    )


def merge(*parts: DataFrame) -> DataFrame:
    """Add up states of partitions, loads or runs."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("load_no", "column_name", "value").agg(*[F.sum(c).alias(c) for c in ("n", "n_pattern", "n_range")])


def profile(st: DataFrame) -> DataFrame:
    """One row per load and column: empty share, distinct values, range, faults."""
    v = F.col("value")
    return st.groupBy("load_no", "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(v.isNull(), F.col("n"))), F.lit(0)).alias("n_empty"),
        F.count(v).alias("n_distinct"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
        F.sum("n_pattern").alias("n_pattern"),
        F.sum("n_range").alias("n_range"),
        F.coalesce(F.max(F.when(v.isNotNull(), F.col("n"))), F.lit(0)).alias("n_top"),
    ).withColumn("empty_share", F.col("n_empty") / F.col("n_rows"))


def distribution_shift(st: DataFrame, columns: list[str]) -> DataFrame:
    """Total variation distance of each load's filled values from all other loads'.

    |p - q| is summed over the values of the load itself; the other loads' mass
    on values that the load lacks is one minus their mass on its own values.
    """
    f = st.where(F.col("value").isNotNull() & F.col("column_name").isin(columns))
    of_value = W.partitionBy("column_name", "value")
    sums = f.groupBy("column_name", "load_no").agg(F.sum("n").alias("n_load"))
    sums = sums.withColumn("n_rest", F.sum("n_load").over(W.partitionBy("column_name")) - F.col("n_load"))
    x = f.withColumn("n_other", F.sum("n").over(of_value) - F.col("n")).join(sums, ["column_name", "load_no"])
    p, q = F.col("n") / F.col("n_load"), F.col("n_other") / F.col("n_rest")
    return (
        x.where(F.col("n_rest") > 0).groupBy("column_name", "load_no")
        .agg((0.5 * (F.sum(F.abs(p - q)) + 1 - F.sum(q))).alias("shift"))
    )


def metrics(st: DataFrame, constraints=REVIEW_CONSTRAINTS) -> DataFrame:
    """(column_name, load_no, metric, value): the measures of each load in long form."""
    full = F.col("n_rows") - F.col("n_empty")
    each = {
        "empty_share": F.col("empty_share"), "n_distinct": F.col("n_distinct").cast("double"), "fault_share": F.try_divide(F.col("n_pattern") + F.col("n_range"), full), "top_share": F.try_divide(F.col("n_top"), full),
    }
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("value")) for m, v in each.items()])
    x = profile(st).select("column_name", "load_no", F.explode(rows).alias("m")).select("column_name", "load_no", "m.*")
    shift = distribution_shift(st, [k.column for k in constraints if k.by_value_distribution])
    return x.unionByName(shift.select("column_name", "load_no", F.lit("shift").alias("metric"), F.col("shift").alias("value"))).where(F.col("value").isNotNull())


@dataclass(frozen=True)
class Limit:
    """An upper control limit: `step` above the median of all loads, or above zero."""

    finding: str
    metric: str
    step: float
    above_median: bool = False
    only: str | None = None


# The limits that name a load; `only` is the flag of the columns they apply to.
REVIEW_LIMITS = (Limit("null_rate", "empty_share", 0.20, above_median=True), Limit("distribution", "shift", 0.35), Limit("constant", "top_share", 0.5, only="by_constant"))


def load_findings(st: DataFrame, constraints=REVIEW_CONSTRAINTS, limits: tuple[Limit, ...] = REVIEW_LIMITS) -> DataFrame:
    """(finding, column_name, case_key = load_no) for the loads beyond a limit.

    Comparisons allow 1e-9 for rounding, so a load exactly on a limit counts.
    """
    m = metrics(st, constraints)
    mid = m.groupBy("column_name", "metric").agg(F.median("value").alias("median"))
    x = m.join(mid, ["column_name", "metric"])
    beyond = []
    for k in limits:
        where = (F.col("metric") == k.metric) & (F.col("value") - (F.col("median") if k.above_median else F.lit(0.0)) >= k.step - 1e-9)
        if k.only:
            where &= F.col("column_name").isin([c.column for c in constraints if getattr(c, k.only)])
        beyond.append(F.when(where, F.lit(k.finding)))
    return x.select(F.explode(F.filter(F.array(*beyond), lambda f: f.isNotNull())).alias("finding"), "column_name", F.col("load_no").cast("bigint").alias("case_key"))


def control_limits(prof: DataFrame, metric: str = "empty_share", width: float = 6.0, floor: float = 0.02) -> DataFrame:
    """Shewhart-style limits per column over all loads: median and MAD.

    The centre is the median over all loads, the scale 1.4826 times the median
    absolute deviation, at least `floor`. Adds centre, scale, signal.
    """
    mid = prof.groupBy("column_name").agg(F.median(metric).alias("centre"))
    x = prof.join(mid, "column_name")
    mad = x.groupBy("column_name").agg((1.4826 * F.median(F.abs(F.col(metric) - F.col("centre")))).alias("mad"))
    x = x.join(mad, "column_name").withColumn("scale", F.greatest("mad", F.lit(floor)))
    return x.withColumn("signal", F.abs(F.col(metric) - F.col("centre")) > width * F.col("scale"))


def history(m: DataFrame, width: float = 6.0, floor: float = 0.02, least: int = 3) -> DataFrame:
    """Each metric of each load against the loads before it: centre, scale, signal.

    The centre is the median of the earlier loads' values, the scale 1.4826 times
    their median absolute deviation, at least `floor` of the centre or `floor`.
    Fewer than `least` earlier loads give no signal. Loads are few; a column's
    history is one value per load.
    """
    w = W.partitionBy("column_name", "metric").orderBy("load_no").rowsBetween(W.unboundedPreceding, -1)
    middle = lambda a: (F.get(F.array_sort(a), F.floor((F.size(a) - 1) / 2).cast("int")) + F.get(F.array_sort(a), F.floor(F.size(a) / 2).cast("int"))) / 2
    x = m.withColumn("past", F.collect_list("value").over(w)).where(F.size("past") >= least).withColumn("centre", middle(F.col("past")))
    x = x.withColumn("spread", F.transform("past", lambda v: F.abs(v - F.col("centre")))).withColumn("scale", F.greatest(1.4826 * middle(F.col("spread")), floor * F.abs("centre"), F.lit(floor)))
    return x.select("column_name", "load_no", "metric", "value", "centre", "scale", (F.abs(F.col("value") - F.col("centre")) > width * F.col("scale") + 1e-9).alias("signal"))


class Store:
    """States of the loads seen so far: Parquet in a shared folder, a partition per load.

    `refresh` scans only loads that are not stored yet (or are named in `again`,
    where late rows came) and replaces their partitions, so it may be repeated
    after a failure. A null load is a load of its own.
    """

    SCHEMA = "column_name string, value string, n bigint, n_pattern bigint, n_range bigint, load_no int"

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or f"{shared_folder(spark)}/states-{uuid4().hex}"
        self.known: list[int | None] | None = [] if path is None else None

    def loads(self) -> list[int | None]:
        if self.known is None:
            try:
                self.known = [r.load_no for r in short_list(self.states(merged=False).select("load_no").distinct())]
            except AnalysisException:  # nothing is stored yet
                self.known = []
        return self.known

    def unseen(self, df: DataFrame, load: str = "load_no", again: tuple[int, ...] = ()) -> DataFrame:
        """The rows of loads that need a scan; the condition reaches the files."""
        done = [k for k in self.loads() if k not in again]
        out = ~F.col(load).isin([k for k in done if k is not None]) if any(k is not None for k in done) else F.lit(True)
        return df.where((F.col(load).isNotNull() & out) | (F.col(load).isNull() if None not in done else F.lit(False))) if done else df

    def refresh(self, df: DataFrame, load: str = "load_no", constraints=REVIEW_CONSTRAINTS, again: tuple[int, ...] = ()) -> Store:
        st = states(self.unseen(df, load, again), load, constraints).withColumn("load_no", F.col("load_no").cast("int"))
        st.hint("rebalance", "load_no").write.option("partitionOverwriteMode", "dynamic").partitionBy("load_no").mode("overwrite").parquet(self.path)
        self.known = None
        return self

    def states(self, merged: bool = True) -> DataFrame:
        st = self.spark.read.schema(self.SCHEMA).parquet(self.path)
        return merge(st) if merged else st


def sketch_states(df: DataFrame, columns: list[str], load: str = "load_no", lg_k: int = 12, top: int = 16) -> DataFrame:
    """Mergeable states of bounded size for columns of any kind, a row per load and column.

    Counts, least and greatest value, a sketch of the distinct values, one of the
    frequent values and one of the lengths.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), filled(F.col(c).cast("string")).alias("value")) for c in columns])
    v = F.col("c.value")
    return df.select(F.col(load).alias("load_no"), F.explode(cells).alias("c")).groupBy("load_no", "c.column_name").agg(
        F.count("*").alias("n_rows"), (F.count("*") - F.count(v)).alias("n_empty"), F.min(v).alias("min_value"), F.max(v).alias("max_value"),
        F.hll_sketch_agg(v, lg_k).alias("distinct"), F.call_function("approx_top_k_accumulate", v, F.lit(8 * top)).alias("frequent"), F.kll_sketch_agg_bigint(F.length(v).cast("bigint")).alias("lengths"),
    )


def merge_sketches(*parts: DataFrame, by: tuple[str, ...] = ("load_no", "column_name")) -> DataFrame:
    """Add up sketch states of partitions, loads or runs; `by` without the load gives the column over all loads."""
    x = reduce(DataFrame.unionByName, parts)
    return x.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_empty").alias("n_empty"), F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"),
        F.hll_union_agg("distinct").alias("distinct"), F.call_function("approx_top_k_combine", F.col("frequent")).alias("frequent"), F.call_function("kll_merge_agg_bigint", F.col("lengths")).alias("lengths"),
    )


def sketch_profile(st: DataFrame) -> DataFrame:
    """Readable figures of sketch states: distinct values, the most frequent value and lengths are estimates."""
    some = F.col("n_rows") > F.col("n_empty")
    length = lambda q: F.when(some, F.kll_sketch_get_quantile_bigint("lengths", F.lit(q)))
    top = F.when(some, F.get(F.filter(F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(2)), lambda t: t["item"].isNotNull()), F.lit(0)))
    return st.select(
        *[c for c in ("load_no", "column_name") if c in st.columns], "n_rows", "n_empty", (F.col("n_empty") / F.col("n_rows")).alias("empty_share"), "min_value", "max_value",
        F.hll_sketch_estimate("distinct").alias("n_distinct"), top["item"].alias("top_value"), (top["count"] / (F.col("n_rows") - F.col("n_empty"))).alias("top_share"),
        length(0.5).alias("median_length"), length(0.95).alias("long_length"),
    )


def findings(df: DataFrame) -> DataFrame:
    """All faulty cells and unusual loads of the review table.

    The states are a few rows per value; they are stored once and serve all metrics.
    """
    return cell_findings(df).unionByName(load_findings(Store(df.sparkSession).refresh(df).states()))

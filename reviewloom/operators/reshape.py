"""From cells and mappings to one row per comment-response pair.

`row_idx` (or any unique order column) is file order. Rounds are integers, a
null identifier has no round. Windows run per identifier or per row, which are
small whatever the size of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reviewloom import rulesdata as D
from reviewloom.functions import rules as R


def structure(mapping: DataFrame) -> DataFrame:
    """Wide where a file maps several comment and several response columns, else long."""
    n = lambda t: F.count_distinct(F.when(F.col("target_column") == t, F.col("source_column")))
    g = mapping.groupBy("source_file").agg(n("comment_text").alias("n_comment"), n("response_text").alias("n_response"))
    return g.withColumn("data_structure", F.when((F.col("n_comment") > 1) & (F.col("n_response") > 1), "wide").otherwise("long"))


def structure_by_headers(headers: DataFrame) -> DataFrame:
    """C20: the same rule on header patterns, for files without mappings."""
    low = F.lower("source_column")
    t = F.when(low.rlike(r"response|reply|answer"), "response_text").when(low.rlike(r"comment\s*\d*|feedback|observation"), "comment_text")
    return structure(headers.withColumn("target_column", t))


def round_columns(mapping: DataFrame) -> DataFrame:
    """The k-th column of a file mapped to a repeated target is its round k."""
    m = mapping.where(F.col("target_column").isin(*D.REPEATED_WORDS))
    w = W.partitionBy("source_file", "target_column").orderBy("col_idx")
    return m.withColumn("round", F.row_number().over(w))


def repeated_by_words(headers: DataFrame) -> DataFrame:
    """Repeated columns by keywords, all of which the header holds, numbered by position."""
    low = F.lower("source_column")
    hit = [F.when(_all(low.contains(w) for w in ws), F.lit(t)) for t, ws in D.REPEATED_WORDS.items()]
    x = headers.withColumn("target_column", F.explode(F.filter(F.array(*hit), lambda t: t.isNotNull())))
    w = W.partitionBy("source_file", "target_column").orderBy("col_idx")
    return x.withColumn("round", F.row_number().over(w))


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out


def sequential_round(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """1, 2, … per identifier in file order; a null identifier has none."""
    n = F.row_number().over(_group(keys, order).orderBy(order))
    return rows.withColumn("round_no", F.when(_all(F.col(k).isNotNull() for k in keys), n))


def _group(keys: list[str], order: str):
    """Windows per key; rows with a null key stand alone instead of forming one large group."""
    return W.partitionBy(*keys, F.when(~_all(F.col(k).isNotNull() for k in keys), F.col(order)))


def mixed_round(rows: DataFrame, keys: list[str], extracted: str, order: str) -> DataFrame:
    """The extracted round, else the group's highest plus a running count of rows without one."""
    p = _group(keys, order)
    upto = F.sum(F.col(extracted).isNull().cast("int")).over(p.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    n = F.coalesce(F.col(extracted), F.coalesce(F.max(extracted).over(p), F.lit(0)) + upto).cast("int")
    return rows.withColumn("round_no", F.when(_all(F.col(k).isNotNull() for k in keys), n))


def long_rounds(rows: DataFrame, file: str, identifier: str, order: str) -> DataFrame:
    """T5: rounds of long files, from identifiers that carry them or by sequence."""
    x = rows.withColumns({"base_id": R.base_id(F.col(identifier)), "extracted": R.id_round(F.col(identifier))})
    return mixed_round(x, [file, "base_id"], "extracted", order)


def longest(columns: list[str]) -> Column:
    """The longest filled value, the first of equals; '' where none is."""
    v = [R.strip(F.col(c)) for c in columns]
    options = F.filter(F.array(*[F.struct(F.length(x).alias("n"), F.lit(-i).alias("at"), x.alias("v")) for i, x in enumerate(v)]), lambda s: F.coalesce(s["n"], F.lit(0)) > 0)
    return F.coalesce(F.array_max(options)["v"], F.lit(""))


def wide_to_long(rows: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """One row per round with a comment or a response.

    rows has, per target t and round k, t_k (absent ones count as null); of the
    metadata, a null, blank or '-' falls back to t_1.
    """
    def col(t: str, k: int) -> Column:
        return F.col(f"{t}_{k}") if f"{t}_{k}" in rows.columns else F.lit(None).cast("string")

    def one(k: int) -> Column:
        c, r = (F.when(has_text(col(t, k)), R.strip(col(t, k))) for t in ("comment_text", "response_text"))
        meta = [F.coalesce(own_value(col(t, k)), own_value(col(t, 1))).alias(t) for t in ("date_received", "date_responded", "status", "comment_type")]
        return F.struct(F.lit(k).alias("round"), c.alias("comment_text"), r.alias("response_text"), *meta)

    x = rows.select(*keys, F.explode(F.array(*[one(k) for k in range(1, rounds + 1)])).alias("p"))
    return x.where("p.comment_text is not null or p.response_text is not null").select(*keys, "p.*").withColumn("response_text", F.coalesce("response_text", F.lit("")))


def auto_id(rows: DataFrame, file: str, order: str, width: int = 100_000) -> DataFrame:
    """1..n per file in order, without sorting a whole file in one task.

    Rows are numbered inside slices of `width` of the (integer) order column and
    shifted by the count of the slices before.
    """
    x = rows.withColumn("slice", F.floor(F.col(order) / width))
    n = x.groupBy(file, "slice").agg(F.count("*").alias("m"))
    before = n.withColumn("before", F.sum("m").over(W.partitionBy(file).orderBy("slice")) - F.col("m")).drop("m")
    place = F.row_number().over(W.partitionBy(file, "slice").orderBy(order))
    return x.withColumn("place", place).join(before, [file, "slice"]).withColumn("auto_id", F.col("place") + F.col("before")).drop("place", "before", "slice")


def agency(has_agency: Column, agency: Column, identifier: Column, author: Column) -> Column:
    """A file's agency column; without one, the identifier's code, then the author's."""
    return F.when(has_agency, R.agency_code(agency)).otherwise(F.coalesce(F.nullif(R.agency_from_id(identifier), F.lit("")), R.agency_from_author(author)))


def by_value(rows: DataFrame, column: str, results: DataFrame) -> DataFrame:
    """rows with the columns of `results`, which has one row per different value of the column (null included).

    For rules that cost much more than a join and columns of few values; Spark
    broadcasts the results where they turn out small and sorts both sides else.
    """
    r = results.withColumnRenamed(column, "_value")
    return rows.join(r, F.equal_null(F.col(column), F.col("_value"))).drop("_value")


def own_value(c: Column) -> Column:
    """A round's own metadata: null, blank and '-' have none."""
    return F.when(~R.strip(c).isin("", "-"), c)


def has_text(c: Column) -> Column:
    """a comment or response that keeps its round."""
    return F.coalesce(R.strip(c) != "", F.lit(False))


def transform(rows: DataFrame, rules: dict[str, callable] | None = None) -> DataFrame:
    """The value rules on their columns; `rules` may replace or add some."""
    own = {"agency": R.agency_code, "author": R.author, "date_received": R.standard_date, "date_responded": R.standard_date, "status": R.status, "comment_type": R.comment_type} | (rules or {})
    return rows.withColumns({c: f(F.col(c)) for c, f in own.items() if c in rows.columns})


def complete(rows: DataFrame, columns: tuple[str, ...] = D.TARGETS + D.METADATA) -> DataFrame:
    """The target schema; missing columns are null."""
    return rows.select(*[F.col(c).cast("string").alias(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns])


def union_by_name(*parts: DataFrame) -> DataFrame:
    """N17."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out

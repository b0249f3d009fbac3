"""Queries of the data quality profile and their SQL twins."""

from pyspark.sql import functions as F

from reviewloom.common import sql_empty, table
from reviewloom.operators import profile as P

_COLS = ("round", "date_received", "status", "source_file")
_DATE = "TRY_CAST(value AS DATE)"
# One row per cell, with its verdict.
_CELLS = (
    "cells AS (SELECT rec_id, load_no, column_name, CASE WHEN " + sql_empty("value") + " THEN NULL ELSE value END AS value FROM ("
    + " UNION ALL ".join(f"SELECT rec_id, load_no, '{c}' AS column_name, {c} AS value FROM normalized_output_example" for c in _COLS)
    + ")), judged AS (SELECT *, CASE WHEN value IS NULL THEN NULL"
    r" WHEN column_name='round' AND NOT regexp_matches(value, '\A[0-9]+\z') THEN 'pattern'"
    r" WHEN column_name='round' AND NOT regexp_matches(value, '\A0*([1-9]|1[0-2])\z') THEN 'range'"
    rf" WHEN column_name='date_received' AND (NOT regexp_matches(value, '\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\z') OR {_DATE} IS NULL) THEN 'pattern'"
    rf" WHEN column_name='date_received' AND NOT year({_DATE}) BETWEEN 2000 AND 2030 THEN 'range'"
    r" WHEN column_name='status' AND (NOT regexp_matches(value, '\p{L}') OR regexp_matches(value, '[\p{Nd}#]')) THEN 'pattern'"
    r" WHEN column_name='source_file' AND NOT regexp_matches(value, '\A[a-z0-9_]+_[0-9]{6}\.xlsx\z') THEN 'pattern' END AS finding FROM cells)"
)
_PROF = (
    "prof AS (SELECT load_no, column_name, count(*) AS n_rows, count(*) - count(value) AS n_empty, count(DISTINCT value) AS n_distinct, min(value) AS min_value, max(value) AS max_value,"
    " count(*) FILTER (finding='pattern') AS n_pattern, count(*) FILTER (finding='range') AS n_range FROM judged GROUP BY ALL)"
)
_SHIFT = (
    "vc AS (SELECT column_name, load_no, value, count(*) AS n FROM cells WHERE value IS NOT NULL AND column_name IN ('round','status') GROUP BY ALL),"
    " grid AS (SELECT l.column_name, l.load_no, v.value FROM (SELECT DISTINCT column_name, load_no FROM vc) l JOIN (SELECT DISTINCT column_name, value FROM vc) v USING (column_name)),"
    " g AS (SELECT column_name, load_no, value, coalesce(n,0) AS n FROM grid LEFT JOIN vc USING (column_name, load_no, value)),"
    " g2 AS (SELECT *, sum(n) OVER (PARTITION BY column_name, load_no) AS nl, sum(n) OVER (PARTITION BY column_name, value) - n AS o, sum(n) OVER (PARTITION BY column_name) - sum(n) OVER (PARTITION BY column_name, load_no) AS nr FROM g),"
    " shift AS (SELECT column_name, load_no, 0.5*sum(abs(n/nl - o/nr)) AS shift FROM g2 WHERE nr > 0 GROUP BY ALL)"
)
_TOP = "top AS (SELECT load_no, column_name, max(n) AS n_top, sum(n) AS n_full FROM (SELECT load_no, column_name, value, count(*) AS n FROM cells WHERE value IS NOT NULL AND column_name='date_received' GROUP BY ALL) GROUP BY ALL)"

FOUND_SQL = (
    f"WITH {_CELLS}, {_PROF}, {_SHIFT}, {_TOP},"
    " rate AS (SELECT *, n_empty/n_rows AS empty_share, median(n_empty/n_rows) OVER (PARTITION BY column_name) AS centre FROM prof)"
    " SELECT finding, column_name, rec_id AS case_key FROM judged WHERE finding IS NOT NULL"
    " UNION ALL SELECT 'null_rate', column_name, load_no FROM rate WHERE empty_share - centre >= 0.20 - 1e-9"
    " UNION ALL SELECT 'distribution', column_name, load_no FROM shift WHERE shift >= 0.35 - 1e-9"
    " UNION ALL SELECT 'constant', column_name, load_no FROM top WHERE n_top >= 0.5*n_full"
)


def _base(spark, d):
    return table(spark, d, "normalized_output_example").select("rec_id", "load_no", *_COLS)


def p2_found(spark, d):
    return P.findings(_base(spark, d))


def p2_profile(spark, d):
    return P.profile(P.states(_base(spark, d))).drop("n_top").withColumn("empty_share", F.round("empty_share", 6))


def p2_incremental(spark, d):
    """The profile after one more load: the newest is scanned alone, the others come from stored states."""
    df = _base(spark, d)
    newest = df.agg(F.max("load_no")).first()[0]
    store = P.Store(spark).refresh(df.where(F.col("load_no") < newest) if newest is not None else df.limit(0))
    return P.profile(store.refresh(df).states()).drop("n_top").withColumn("empty_share", F.round("empty_share", 6))


def p2_history(spark, d):
    x = P.history(P.metrics(P.Store(spark).refresh(_base(spark, d)).states()))
    return x.select("column_name", "load_no", "metric", *[F.round(c, 6).alias(c) for c in ("value", "centre", "scale")], "signal")


def p2_table_profile(spark, d):
    """Every column of the table, ids and texts included, by sketches."""
    df = table(spark, d, "normalized_output_example")
    return P.sketch_profile(P.sketch_states(df, [c for c in df.columns if c != "load_no"]))


def p2_control_limits(spark, d):
    x = P.control_limits(P.profile(P.Store(spark).refresh(_base(spark, d)).states()))
    return x.select("load_no", "column_name", F.round("empty_share", 6).alias("empty_share"), F.round("centre", 6).alias("centre"), "signal")


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile, "p2_control_limits": p2_control_limits, "p2_incremental": p2_incremental, "p2_history": p2_history, "p2_table_profile": p2_table_profile}
SQL = {
    "p2_incremental": f"WITH {_CELLS}, {_PROF} SELECT *, round(n_empty/n_rows, 6) AS empty_share FROM prof",
    "p2_history": (
        f"WITH {_CELLS}, {_PROF}, {_SHIFT}, tops AS (SELECT load_no, column_name, max(n) AS n_top FROM (SELECT load_no, column_name, value, count(*) AS n FROM cells WHERE value IS NOT NULL GROUP BY ALL) GROUP BY ALL),"
        " m AS (SELECT column_name, load_no, 'empty_share' AS metric, n_empty / n_rows AS value FROM prof UNION ALL SELECT column_name, load_no, 'n_distinct', n_distinct FROM prof"
        " UNION ALL SELECT column_name, load_no, 'fault_share', (n_pattern + n_range) / nullif(n_rows - n_empty, 0) FROM prof UNION ALL SELECT column_name, load_no, 'top_share', n_top / nullif(n_rows - n_empty, 0) FROM prof JOIN tops USING (load_no, column_name)"
        " UNION ALL SELECT column_name, load_no, 'shift', shift FROM shift),"
        " h AS (SELECT *, list(value) OVER (PARTITION BY column_name, metric ORDER BY load_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM m WHERE value IS NOT NULL),"
        " c AS (SELECT *, list_aggregate(past, 'median') AS centre FROM h WHERE len(past) >= 3),"
        " s AS (SELECT *, greatest(1.4826 * list_aggregate(list_transform(past, lambda x: abs(x - centre)), 'median'), 0.02 * abs(centre), 0.02) AS scale FROM c)"
        " SELECT column_name, load_no, metric, round(value, 6) AS value, round(centre, 6) AS centre, round(scale, 6) AS scale, abs(value - centre) > 6 * scale + 1e-9 AS signal FROM s"
    ),
    "p2_found": FOUND_SQL,
    "p2_profile": f"WITH {_CELLS}, {_PROF} SELECT *, round(n_empty/n_rows, 6) AS empty_share FROM prof",
    "p2_control_limits": f"WITH {_CELLS}, {_PROF}, r AS (SELECT load_no, column_name, n_empty/n_rows AS e, median(n_empty/n_rows) OVER (PARTITION BY column_name) AS c FROM prof),"
    " m AS (SELECT *, greatest(1.4826*median(abs(e-c)) OVER (PARTITION BY column_name), 0.02) AS s FROM r)"
    " SELECT load_no, column_name, round(e,6) AS empty_share, round(c,6) AS centre, abs(e-c) > 6*s AS signal FROM m",
}

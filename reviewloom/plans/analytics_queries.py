"""Analytic queries with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.common import sql_empty, table
from reviewloom.operators import analytics as A

_NUM = r"CASE WHEN regexp_matches(round, '^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$') THEN TRY_CAST(regexp_replace(round, '\s+', '', 'g') AS DOUBLE) END"
_TEXT = ("project", "agency", "author", "status", "comment_type", "comment_id", "section", "topic", "comment_text", "response_text")


def sql_filled(c: str) -> str:
    return f"CASE WHEN NOT {sql_empty(c)} THEN {c} END"


def _date(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({c} AS DATE) END"


RV = (
    "rv0 AS (SELECT rec_id, " + ", ".join(f"{sql_filled(c)} AS {c}" for c in _TEXT) + f", {_NUM} AS round, {_date('date_received')} AS date_received, {_date('date_responded')} AS date_responded FROM normalized_output_example),"
    " rv AS (SELECT *, CAST(date_responded - date_received AS DOUBLE) AS rt, CASE WHEN round >= 3 THEN '3+' WHEN round = 1 THEN '1' WHEN round = 2 THEN '2' END AS rg FROM rv0)"
)


def _rv(spark, d):
    return A.review(table(spark, d, "normalized_output_example"))


QUERIES: dict = {}
SQL: dict[str, str] = {}


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: f(_rv(spark, d))
    if sql:
        SQL[name] = f"WITH {RV} {sql}"


_TOPA = "SELECT agency, count(*) AS n FROM rv WHERE agency IS NOT NULL GROUP BY 1 ORDER BY n DESC, agency LIMIT"
_Q = {
    "g01_round1_count": "SELECT count(*) FILTER (round = 1) AS answer FROM rv",
    "g02_most_common_agency": f"SELECT agency FROM ({_TOPA} 1)",
    "g03_round_with_most_rows": "SELECT round FROM rv WHERE round IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, round LIMIT 1",
    "g04_most_common_agency_rows": f"SELECT n FROM ({_TOPA} 1)",
    "g05_unanswered_count": "SELECT count(*) FILTER (date_responded IS NULL) AS answer FROM rv",
    "g06_median_days_round2": "SELECT round(median(rt), 2) AS answer FROM rv WHERE round = 2",
    "g07_agency_lowest_median": "SELECT agency FROM rv WHERE agency IS NOT NULL AND rt IS NOT NULL GROUP BY 1 ORDER BY median(rt), agency LIMIT 1",
    "g08_share_within_30_round2": "SELECT round(coalesce(avg(CAST(rt <= 30 AS INT)) * 100, 0.0), 2) AS answer FROM rv WHERE round = 2 AND rt IS NOT NULL",
    "g09_round1_top_agency": "SELECT agency FROM rv WHERE agency IS NOT NULL AND round = 1 GROUP BY 1 ORDER BY count(*) DESC, agency LIMIT 1",
    "g10_agency_highest_unanswered": "SELECT agency FROM rv WHERE agency IS NOT NULL GROUP BY 1 ORDER BY avg(CAST(date_responded IS NULL AS INT)) DESC, agency LIMIT 1",
    "g11_agency_highest_p90": "SELECT agency, round(quantile_cont(rt, 0.9), 6) AS p90 FROM rv WHERE agency IS NOT NULL AND rt IS NOT NULL GROUP BY 1 ORDER BY quantile_cont(rt, 0.9) DESC, agency LIMIT 1",
    "g12_unanswered_last_90_days": "SELECT count(*) AS answer FROM rv WHERE date_responded IS NULL AND date_received >= (SELECT max(date_received) FROM rv) - 90",
    "g13_project_highest_median": "SELECT project FROM rv WHERE project IS NOT NULL AND rt IS NOT NULL GROUP BY 1 ORDER BY median(rt) DESC, project LIMIT 1",
    "g14_agency_largest_increase": "SELECT agency FROM (SELECT agency, avg(rt) FILTER (round >= 3) - avg(rt) FILTER (round = 1) AS v FROM rv WHERE agency IS NOT NULL GROUP BY 1) WHERE v IS NOT NULL ORDER BY v DESC, agency LIMIT 1",
    "g15_top_pair_share": "SELECT printf('%s | %s | share=%.4f', project, agency, s) AS answer FROM (SELECT project, agency, n / sum(n) OVER (PARTITION BY project) AS s FROM (SELECT project, agency, count(*) AS n FROM rv WHERE project IS NOT NULL AND agency IS NOT NULL GROUP BY ALL)) ORDER BY s DESC, project, agency LIMIT 1",
}
for _k, _f in A.QUESTIONS.items():
    _add(_k, _f, _Q[_k])

_PLOT = f"x AS (SELECT coalesce(t.agency, 'Other') AS agency_plot, rg FROM rv LEFT JOIN ({_TOPA} 6) t ON rv.agency = t.agency WHERE rg IS NOT NULL), y AS (SELECT agency_plot, count(*) FILTER (rg='1') AS r1, count(*) FILTER (rg='2') AS r2, count(*) FILTER (rg='3+') AS r3plus FROM x GROUP BY 1), z AS (SELECT *, r1+r2 AS c2, r1+r2+r3plus AS c3plus FROM y)"
_add("rt_by_round", A.by_round_group, "SELECT g.rg AS round_group, round(avg(rt), 6) AS mean_days, round(median(rt), 6) AS median_days, count(rt) AS n FROM (VALUES ('1'),('2'),('3+')) g(rg) LEFT JOIN rv USING (rg) GROUP BY 1")
_add("top_projects", lambda r: A.top(r, "project", 13), "SELECT project, count(*) AS n FROM rv WHERE project IS NOT NULL GROUP BY 1 ORDER BY n DESC, project LIMIT 13")
_add("top_agencies", lambda r: A.top(r, "agency", 6), f"{_TOPA} 6")
_add("top10_projects", lambda r: A.top(r, "project", 10), "SELECT project, count(*) AS n FROM rv WHERE project IS NOT NULL GROUP BY 1 ORDER BY n DESC, project LIMIT 10")
_add("top10_agencies", lambda r: A.top(r, "agency", 10), f"{_TOPA} 10")
_add("top_types", lambda r: A.top(r, "comment_type", 10), "SELECT comment_type, count(*) AS n FROM rv WHERE comment_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, comment_type LIMIT 10")
SQL["agency_round_pivot_cumsum"] = f"WITH {RV}, {_PLOT} SELECT * FROM z"
SQL["agency_pies"] = f"WITH {RV}, {_PLOT}, p AS (SELECT agency_plot, '1' AS pie, r1 AS n FROM z UNION ALL SELECT agency_plot, '2', c2 FROM z UNION ALL SELECT agency_plot, '3+', c3plus FROM z) SELECT *, round(100.0*n/sum(n) OVER (PARTITION BY pie), 4) AS percent, 100.0*n/sum(n) OVER (PARTITION BY pie) >= 6 AS labelled FROM p"
_add("agency_round_pivot_cumsum", A.agency_rounds)
_add("agency_pies", lambda r: A.pies(A.agency_rounds(r)))
_add("ecdf", A.ecdf, "SELECT agency, rg AS round_group, rt AS response_days, row_number() OVER w AS i, round(row_number() OVER w / count(*) OVER (PARTITION BY agency, rg), 9) AS y FROM rv WHERE agency IS NOT NULL AND rg IS NOT NULL AND rt IS NOT NULL WINDOW w AS (PARTITION BY agency, rg ORDER BY rt)")
_COV = ("comment_id", "section", "topic", "round", "comment_type", "comment_text", "response_text", "author", "date_received", "date_responded", "status", "agency")
_add("coverage", lambda r: A.coverage(r.withColumns({c: F.col(c).cast("string") for c in ("round", "date_received", "date_responded")}), _COV), " UNION ALL ".join(f"SELECT '{c}' AS column_name, count({c}) AS filled, round(100.0*count({c})/count(*), 4) AS percent FROM rv" for c in _COV))
_add("distinct_totals", lambda r: r.agg(F.count("*").alias("rows"), F.count_distinct("project").alias("projects"), F.count_distinct("agency").alias("agencies")), "SELECT count(*) AS rows, count(DISTINCT project) AS projects, count(DISTINCT agency) AS agencies FROM rv")
_add("progression", A.progression, "SELECT count(*) AS with_r1, coalesce(sum(r2),0)::BIGINT AS with_r2, coalesce(sum(r3),0)::BIGINT AS with_r3, round(100.0*sum(r2)/count(*),4) AS pct_r2, round(100.0*sum(r3)/count(*),4) AS pct_r3 FROM (SELECT max((round=1)::INT) AS r1, max((round=2)::INT) AS r2, max((round=3)::INT) AS r3 FROM rv WHERE project IS NOT NULL AND comment_id IS NOT NULL GROUP BY project, comment_id) WHERE r1 = 1")
_AP = "SELECT project, days, printf('%dy %dm %dd', days // 365, (days % 365) // 30, (days % 365) % 30) AS approval FROM (SELECT project, max(date_responded) - min(date_received) AS days FROM rv WHERE project IS NOT NULL GROUP BY 1) WHERE days IS NOT NULL"
_add("approval_time", A.approval_time, _AP)
_add("approval_summary", lambda r: A.approval_time(r).agg(F.max("days").alias("max_days"), F.round(F.avg("days"), 6).alias("mean_days")), f"SELECT max(days) AS max_days, round(avg(days), 6) AS mean_days FROM ({_AP})")
_add("project_report", A.project_report, "SELECT project, count(*) AS n, max(round) AS max_round, count(*) FILTER (round=1) AS n_r1, count(*) FILTER (round=2) AS n_r2, count(*) FILTER (round=3) AS n_r3, round(100.0*count(*)/sum(count(*)) OVER (), 4) AS percent FROM rv WHERE project IS NOT NULL GROUP BY 1")
_add("mean_rt_by_round", lambda r: r.where(f"{A.RT} > 0 and {A.RT} < 1000 and round is not null").groupBy("round").agg(F.round(F.avg(A.RT), 6).alias("mean_days")), "SELECT round, round(avg(rt), 6) AS mean_days FROM rv WHERE rt > 0 AND rt < 1000 AND round IS NOT NULL GROUP BY 1")
_add("slowest_threads", lambda r: r.where(f"round = 3 and {A.RT} is not null and project is not null and comment_id is not null").groupBy("project", "comment_id", "round").agg(F.avg(A.RT).alias("v")).orderBy(F.desc("v"), "project", "comment_id").limit(5).select("project", "comment_id", "round", F.round("v", 6).alias("mean_days")), "SELECT project, comment_id, round, round(avg(rt), 6) AS mean_days FROM rv WHERE round = 3 AND rt IS NOT NULL AND project IS NOT NULL AND comment_id IS NOT NULL GROUP BY ALL ORDER BY avg(rt) DESC, project, comment_id LIMIT 5")
_add("scalars", lambda r: r.agg(F.count("*").alias("rows"), F.count_distinct("project").alias("projects"), F.count_distinct("agency").alias("agencies"), F.count_distinct("comment_id").alias("ids"), F.round(F.avg(A.RT), 6).alias("mean_days"), F.max(A.RT).alias("max_days"), F.count_if(F.col(A.RT) > 30).alias("over_30")), "SELECT count(*) AS rows, count(DISTINCT project) AS projects, count(DISTINCT agency) AS agencies, count(DISTINCT comment_id) AS ids, round(avg(rt), 6) AS mean_days, max(rt) AS max_days, count(*) FILTER (rt > 30) AS over_30 FROM rv")
_add("share_of_total", lambda r: A.share_of_total(r).withColumn("share", F.round("share", 9)), "SELECT project, agency, n, round(n / sum(n) OVER (PARTITION BY project), 9) AS share FROM (SELECT project, agency, count(*) AS n FROM rv WHERE project IS NOT NULL AND agency IS NOT NULL GROUP BY ALL)")
_add("semi_top", lambda r: r.join(A.top(r, "project", 13), "project", "left_semi").groupBy("project").agg(F.count("*").alias("n"), F.count(A.RT).alias("answered")), "SELECT project, count(*) AS n, count(rt) AS answered FROM rv WHERE project IN (SELECT project FROM rv WHERE project IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, project LIMIT 13) GROUP BY 1")
_add("date_window", lambda r: r.where(F.col("date_received").between("2018-06-01", "2019-12-31")).select("rec_id", F.col("date_received").cast("string")), "SELECT rec_id, date_received::VARCHAR AS date_received FROM rv WHERE date_received BETWEEN DATE '2018-06-01' AND DATE '2019-12-31'")
_add("response_sane", lambda r: A.sane(r).select("rec_id", A.RT), "SELECT rec_id, rt AS response_days FROM rv WHERE date_responded IS NOT NULL AND rt BETWEEN 0 AND 5000")
_add("years_since_2000", lambda r: r.where((F.year("date_received") >= 2000) & (F.year("date_responded") >= 2000)).select("rec_id"), "SELECT rec_id FROM rv WHERE year(date_received) >= 2000 AND year(date_responded) >= 2000")

_add("response_days", lambda r: r.where(f"{A.RT} is not null").select("rec_id", A.RT), "SELECT rec_id, rt AS response_days FROM rv WHERE rt IS NOT NULL")
_add("round_group", lambda r: r.select("rec_id", "round_group"), "SELECT rec_id, rg AS round_group FROM rv")
_add("r1_r3plus_label", lambda r: r.select("rec_id", A.R.round_label(F.col("round")).alias("label")), "SELECT rec_id, CASE WHEN round=1 THEN 'r1' WHEN round>=3 THEN 'r3plus' ELSE 'other' END AS label FROM rv")
_add("group_filter", lambda r: r.where(A.R.round_label(F.col("round")).isin("r1", "r3plus")).groupBy(A.R.round_label(F.col("round")).alias("label")).agg(F.count("*").alias("n")), "SELECT CASE WHEN round=1 THEN 'r1' ELSE 'r3plus' END AS label, count(*) AS n FROM rv WHERE round=1 OR round>=3 GROUP BY 1")
_add("coerce_casts", lambda r: r.select("rec_id", "round", F.col("date_received").cast("string"), F.col("date_responded").cast("string")), "SELECT rec_id, round, date_received::VARCHAR AS date_received, date_responded::VARCHAR AS date_responded FROM rv")
_add("slow_answers", lambda r: r.where(f"{A.RT} > 30").select("rec_id"), "SELECT rec_id FROM rv WHERE rt > 30")
_MISS = ("comment_id", "comment_text", "project", "author", "date_received", "response_text", "status", "agency")
_add("quality_rules", A.quality, "SELECT " + ", ".join(f"count(*) FILTER ({c} IS NULL) AS missing_{c}" for c in _MISS) + ", count(*) FILTER (NOT year(date_received) BETWEEN 2000 AND 2030) AS bad_year, count(*) FILTER (NOT length(comment_text) BETWEEN 10 AND 10000) AS bad_length FROM rv")

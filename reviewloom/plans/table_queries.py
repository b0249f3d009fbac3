"""Table-level operators (ingest, matching, reshape), with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom import rulesdata as D
from reviewloom.common import sql_empty, table
from reviewloom.functions import rules as R
from reviewloom.functions.similarity import name_ratio
from reviewloom.operators import ingest as I
from reviewloom.operators import matching as M
from reviewloom.operators import reshape as S
from reviewloom.plans.rule_queries import _q, first, sql_agency_once, sql_by_dictionary, sql_date, strip

QUERIES: dict = {}
SQL: dict[str, str] = {}
_N, _J, _C, _V, _MP = "normalized_output_example", "jellyfish_input_example", "workbook_cells", "voting_stats", "column_mapping"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- ingest

_CLEAN = f"cl AS (SELECT * FROM {_C} WHERE NOT {sql_empty('cell_value')})"
_FULL = f"fc AS (SELECT *, {strip('cell_value')} AS v FROM {_C} WHERE cell_value IS NOT NULL AND row_idx <= 20)"
_HITS = " + ".join(f"contains(row_text, '{k}')::INT" for k in D.HEADER_WORDS)


def _scores(src: str) -> str:
    return (
        f"rt AS (SELECT source_file, row_idx, lower(string_agg(cell_value, ' ' ORDER BY col_idx, cell_value)) AS row_text, count(*) FILTER (v <> '') AS n_cells, coalesce(avg(length(v)) FILTER (v <> ''), 0) AS mean_length FROM {src} GROUP BY ALL),"
        f" sc AS (SELECT source_file, row_idx, n_cells, mean_length, {_HITS} AS hits FROM rt), ss AS (SELECT *, hits - least(mean_length/50.0, 3.0) AS score FROM sc)"
    )


@query(f"WITH {_FULL}, {_scores('fc')} SELECT source_file, row_idx, n_cells, hits, round(mean_length, 6) AS mean_length, round(score, 6) AS score FROM ss")
def header_score(spark, d):
    x = I.score_rows(table(spark, d, _C))
    return x.select("source_file", "row_idx", "n_cells", "hits", F.round("mean_length", 6).alias("mean_length"), F.round("score", 6).alias("score"))


_HEADER = f"{_CLEAN}, cv AS (SELECT *, {strip('cell_value')} AS v FROM cl WHERE row_idx <= 20), {_scores('cv')}, hr AS (SELECT f.source_file, coalesce(h.row_idx, 0) AS header_row FROM (SELECT DISTINCT source_file FROM cl) f LEFT JOIN (SELECT source_file, row_idx FROM ss WHERE hits >= 3 AND n_cells >= 5 QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY score DESC, row_idx, hits DESC) = 1) h USING (source_file))"


@query(f"WITH {_HEADER} SELECT * FROM hr")
def header_row(spark, d):
    return I.header_row(I.clean(table(spark, d, _C)))


_NAMES = (
    f"{_HEADER}, hc AS (SELECT c.source_file, col_idx, max({strip('cell_value')}) FILTER (row_idx = header_row) AS h FROM cl c JOIN hr USING (source_file) WHERE row_idx >= header_row GROUP BY ALL),"
    " nm AS (SELECT *, coalesce(h, 'Column_' || (row_number() OVER (PARTITION BY source_file ORDER BY col_idx) - 1)) AS name FROM hc),"
    " nk AS (SELECT *, row_number() OVER (PARTITION BY source_file, name ORDER BY col_idx) - 1 AS k FROM nm), nn AS (SELECT source_file, col_idx, CASE WHEN k > 0 THEN name || '_' || k ELSE name END AS source_column FROM nk)"
)


@query(f"WITH {_NAMES} SELECT * FROM nn")
def name_dedupe(spark, d):
    c = table(spark, d, _C)
    return I.column_names(c, I.header_row(I.clean(c)))


@query(f"WITH {_NAMES} SELECT c.source_file, row_idx, col_idx, source_column, cell_value, vtype FROM cl c JOIN hr USING (source_file) JOIN nn USING (source_file, col_idx) WHERE row_idx > header_row")
def read_cells(spark, d):
    return I.read(table(spark, d, _C))


_PREF, _SKIP = (" OR ".join(f"contains(lower(sheet), '{w}')" for w in ws) for ws in (D.PREFER_SHEETS, D.SKIP_SHEETS))


@query(f"SELECT source_file, sheet, sheet_idx, n_rows FROM (SELECT source_file, sheet, sheet_idx, max(row_idx)+1 AS n_rows, coalesce(({_PREF}) AND NOT ({_SKIP}), false) AS cand FROM {_C} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source_file ORDER BY cand DESC, CASE WHEN cand THEN -n_rows END, sheet_idx) = 1")
def sheet_select(spark, d):
    return I.select_sheet(table(spark, d, _C))


# -------------------------------------------------------------- matching

_SRC = f"src AS (SELECT DISTINCT source_file, source_column FROM {_J})"


@query(f"WITH {_SRC}, t AS (SELECT DISTINCT target_column FROM {_J} WHERE target_column IS NOT NULL) SELECT * FROM src CROSS JOIN t")
def pair_cross(spark, d):
    j = table(spark, d, _J)
    return M.pair_table(j.select("source_file", "source_column").distinct(), j.where("target_column is not null").select("target_column").distinct())


_DATA = f"{_NAMES}, dv AS (SELECT DISTINCT c.source_file, source_column, cell_value FROM cl c JOIN hr USING (source_file) JOIN nn USING (source_file, col_idx) WHERE row_idx > header_row)"


@query(f"WITH {_DATA}, p AS (SELECT *, row_number() OVER (PARTITION BY source_file, source_column ORDER BY md5('42' || cell_value), cell_value) AS k FROM dv) SELECT source_file, source_column, max(cell_value) FILTER (k=1) AS sample_1, max(cell_value) FILTER (k=2) AS sample_2, max(cell_value) FILTER (k=3) AS sample_3 FROM p GROUP BY ALL")
def samples3(spark, d):
    return M.samples(I.read(table(spark, d, _C)), ["source_file", "source_column"], "cell_value")


def _vectors(spark, d):
    e = table(spark, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    half = lambda a, b: F.transform(v, lambda x, i: F.when((i >= a) & (i < b), x).otherwise(0.0))
    src = e.select(F.col("vec_id").cast("string").alias("source_column"), v.alias("v1"), half(0, 32).alias("v2"), half(32, 64).alias("v3"))
    tgt = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    return src, tgt.select(F.col("label").cast("string").alias("target_column"), F.transform("e", lambda x: x.cast("double")).alias("v"))


_COS = (
    "e AS (SELECT vec_id::VARCHAR AS source_column, embedding::DOUBLE[] AS v1, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0.0 END) AS v2, list_transform(embedding::DOUBLE[], lambda x, i: CASE WHEN i > 32 AND i <= 64 THEN x ELSE 0.0 END) AS v3 FROM embeddings),"
    " t AS (SELECT label::VARCHAR AS target_column, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings GROUP BY label),"
    " s AS (SELECT source_column, target_column, [coalesce(list_cosine_similarity(v1, v), 0), coalesce(list_cosine_similarity(v2, v), 0), coalesce(list_cosine_similarity(v3, v), 0)] AS sims FROM e CROSS JOIN t),"
    " b AS (SELECT *, list_max(sims) AS best, list_position(sims, list_max(sims)) AS best_description_num FROM s),"
    " k AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY source_column ORDER BY round(best, 9) DESC, target_column) <= 5)"
)


@query(f"WITH {_COS} SELECT source_column, target_column, round(best, 4) AS similarity_score, best_description_num FROM k WHERE best >= 0.25")
def cosine_topk(spark, d):
    return M.prefilter(*_vectors(spark, d))


@query(f"WITH {_COS} SELECT source_column, target_column, best_description_num FROM k")
def best_desc(spark, d):
    return M.prefilter(*_vectors(spark, d), threshold=-2.0).select("source_column", "target_column", "best_description_num")


_CAND = "cand AS (SELECT source_column, target_column, length(source_column) * 1.0 / (1 + length(target_column)) + pair_id % 7 AS similarity_score, pair_id FROM jellyfish_input_example WHERE source_column IS NOT NULL AND target_column IS NOT NULL)"


def _cand(spark, d):
    j = table(spark, d, _J).where("source_column is not null and target_column is not null")
    return j.select("source_column", "target_column", (F.length("source_column") * 1.0 / (1 + F.length("target_column")) + F.col("pair_id") % 7).cast("double").alias("similarity_score"), "pair_id")


@query(f"WITH {_CAND} SELECT source_column, target_column, pair_id, round(similarity_score, 6) AS similarity_score FROM cand QUALIFY row_number() OVER (PARTITION BY source_column, target_column ORDER BY similarity_score DESC, pair_id) = 1")
def dedupe_best(spark, d):
    x = M.first_by(_cand(spark, d), ["source_column", "target_column"], F.desc("similarity_score"), "pair_id")
    return x.select("source_column", "target_column", "pair_id", F.round("similarity_score", 6).alias("similarity_score"))


@query(f"WITH {_CAND}, b AS (SELECT * FROM cand WHERE similarity_score >= 5 QUALIFY row_number() OVER (PARTITION BY source_column, target_column ORDER BY similarity_score DESC) = 1) SELECT p.pair_id, source_column, target_column, round(b.similarity_score, 6) AS similarity_score FROM {_J} p JOIN b USING (source_column, target_column)")
def candidate_join(spark, d):
    x = M.expand(_cand(spark, d).where("similarity_score >= 5").drop("pair_id"), table(spark, d, _J))
    return x.select("pair_id", "source_column", "target_column", F.round("similarity_score", 6).alias("similarity_score"))


@query(f"SELECT pair_id, CASE WHEN output_1 = output_2 OR output_1 = output_3 THEN output_1 WHEN output_2 = output_3 THEN output_2 ELSE 'Yes' END AS answer FROM {_V}")
def vote(spark, d):
    return table(spark, d, _V).select("pair_id", M.vote(*[F.col(f"output_{i}") for i in (1, 2, 3)]).alias("answer"))


_VOTED = f"vt AS (SELECT *, CASE WHEN output_1 = output_2 OR output_1 = output_3 THEN output_1 WHEN output_2 = output_3 THEN output_2 ELSE 'Yes' END AS f FROM {_V}), vs AS (SELECT pair_id, f, output_1 = output_2 AND output_2 = output_3 AS u, (output_1 = f)::INT + (output_2 = f)::INT + (output_3 = f)::INT AS a FROM vt)"


@query(f"WITH {_VOTED} SELECT pair_id, f AS processed_output, u AS unanimous, a AS agreement_level FROM vs")
def voting_stats(spark, d):
    v = table(spark, d, _V).select("pair_id", "output_1", "output_2", "output_3")
    return M.voted(v).select("pair_id", "processed_output", "unanimous", "agreement_level")


@query(f"WITH {_VOTED} SELECT count(*) AS pairs, count(*) FILTER (u) AS unanimous, count(*) FILTER (a >= 2) AS at_least_two, count(*) FILTER (a < 2) AS split, round(100.0*count(*) FILTER (u)/count(*), 4) AS pct_unanimous, round(100.0*count(*) FILTER (a >= 2)/count(*), 4) AS pct_two FROM vs")
def voting_summary(spark, d):
    return M.voting_summary(M.voted(table(spark, d, _V).select("pair_id", "output_1", "output_2", "output_3")))


_UV = f"uv AS (SELECT source_column, target_column, processed_output FROM {_V} QUALIFY row_number() OVER (PARTITION BY source_column, target_column ORDER BY pair_id) = 1)"


@query(
    f"SELECT p.pair_id, p.source_column, p.target_column, coalesce(v.output_1, 'Unknown') AS processed_output_1, coalesce(v.output_2, 'Unknown') AS processed_output_2, coalesce(v.output_3, 'Unknown') AS processed_output_3, coalesce(v.processed_output, 'Unknown') AS processed_output,"
    " " + ", ".join(f"'Not generated (filtered out)' AS prompt_{i}, 'Not processed (filtered out)' AS raw_output_{i}" for i in (1, 2, 3)) +
    f" FROM {_J} p LEFT JOIN (SELECT * FROM {_V} QUALIFY row_number() OVER (PARTITION BY source_column, target_column ORDER BY pair_id) = 1) v USING (source_column, target_column)"
)
def propagate(spark, d):
    once = M.first_by(table(spark, d, _V), ["source_column", "target_column"], "pair_id")
    return M.propagate(table(spark, d, _J).select("pair_id", "source_column", "target_column"), once)


@query(f"SELECT source_column, target_column, source_file, count(*) AS n FROM {_J} GROUP BY ALL HAVING count(*) > 1")
def dup_check(spark, d):
    return M.duplicates(table(spark, d, _J), ["source_column", "target_column", "source_file"])


@query(f"SELECT *, round(100.0*(1 - kept_pairs/all_pairs), 4) AS reduction_percent FROM (SELECT count(*) AS all_rows, count(DISTINCT (source_column, target_column)) AS all_pairs FROM {_J}), (SELECT count(*) AS kept_rows, count(DISTINCT (source_column, target_column)) AS kept_pairs FROM {_V})")
def filter_summary(spark, d):
    return M.filter_summary(table(spark, d, _J), table(spark, d, _V))


@query(f"SELECT min(pair_id) AS pair_id, source_column, target_column, source_file FROM {_J} GROUP BY ALL")
def distinct_pairs(spark, d):
    x = M.first_by(table(spark, d, _J), ["source_column", "target_column", "source_file"], "pair_id")
    return x.select("pair_id", "source_column", "target_column", "source_file")


@query(f"SELECT min(pair_id) AS pair_id, source_column, target_column FROM {_J} GROUP BY source_column, target_column")
def distinct_unique(spark, d):
    return M.first_by(table(spark, d, _J), ["source_column", "target_column"], "pair_id").select("pair_id", "source_column", "target_column")


@query(f"SELECT pair_id FROM {_J} WHERE target_column IS DISTINCT FROM 'status' ORDER BY pair_id LIMIT 100")
def test_mode_head(spark, d):
    return table(spark, d, _J).where(~F.col("target_column").eqNullSafe("status")).select("pair_id").orderBy("pair_id").limit(100)


@query(f"SELECT pair_id FROM {_J} ORDER BY md5(pair_id::VARCHAR), pair_id LIMIT 100")
def test_mode_sample(spark, d):
    return table(spark, d, _J).select("pair_id").orderBy(F.md5(F.col("pair_id").cast("string")), "pair_id").limit(100)


_ORDER = "ro AS (SELECT *, md5(concat_ws('|', source_file, source_column, target_column)) AS result_order FROM column_mapping WHERE confidence = 'Yes')"


def _mapping(spark, d):
    m = table(spark, d, _MP)
    return m.withColumn("result_order", F.md5(F.concat_ws("|", "source_file", "source_column", "target_column")))


@query(f"WITH {_ORDER} SELECT source_column, target_column, source_file FROM ro WHERE target_column IN ('comment_id','agency','author') QUALIFY row_number() OVER (PARTITION BY target_column, source_file ORDER BY result_order) = 1")
def first_mapping(spark, d):
    x = _mapping(spark, d).where("confidence = 'Yes'").where(F.col("target_column").isin("comment_id", "agency", "author"))
    return M.first_by(x, ["target_column", "source_file"], "result_order").select("source_column", "target_column", "source_file")


@query()
def resolve_mappings(spark, d):
    return M.resolve(_mapping(spark, d)).select("source_column", "target_column", "source_file", "confidence")


@query()
def name_similarity(spark, d):
    x = table(spark, d, _J).where("source_column is not null and target_column is not null").select("source_column", "target_column").distinct()
    return x.withColumn("ratio", F.round(name_ratio(R.column_name(F.col("source_column")), R.column_name(F.col("target_column"))), 4))


# --------------------------------------------------------------- reshape


@query(f"SELECT source_file, n_comment, n_response, CASE WHEN n_comment > 1 AND n_response > 1 THEN 'wide' ELSE 'long' END AS data_structure FROM (SELECT source_file, count(DISTINCT source_column) FILTER (target_column = 'comment_text') AS n_comment, count(DISTINCT source_column) FILTER (target_column = 'response_text') AS n_response FROM {_MP} WHERE confidence = 'Yes' GROUP BY 1)")
def structure(spark, d):
    return S.structure(table(spark, d, _MP).where("confidence = 'Yes'"))


_REP = ",".join(map(_q, D.REPEATED_WORDS))


@query(f"WITH {_NAMES} SELECT source_file, target_column, source_column, col_idx, row_number() OVER (PARTITION BY source_file, target_column ORDER BY col_idx) AS round FROM (SELECT DISTINCT source_file, source_column, target_column FROM {_MP} WHERE confidence = 'Yes') m JOIN nn USING (source_file, source_column) WHERE target_column IN ({_REP})")
def round_columns(spark, d):
    m = table(spark, d, _MP).where("confidence = 'Yes'").select("source_file", "source_column", "target_column").distinct()
    c = table(spark, d, _C)
    names = I.column_names(c, I.header_row(I.clean(c)))
    return S.round_columns(m.join(names, ["source_file", "source_column"])).select("source_file", "target_column", "source_column", "col_idx", "round")


_LW = [f"({' AND '.join(f'contains(lower(source_column), {_q(w)})' for w in ws)}, {_q(t)})" for t, ws in D.REPEATED_WORDS.items()]


@query(f"WITH {_NAMES}, r AS (" + " UNION ALL ".join(f"SELECT source_file, source_column, col_idx, {_q(t)} AS target_column FROM nn WHERE {' AND '.join(f'contains(lower(source_column), {_q(w)})' for w in ws)}" for t, ws in D.REPEATED_WORDS.items()) + ") SELECT *, row_number() OVER (PARTITION BY source_file, target_column ORDER BY col_idx) AS round FROM r")
def repeated_by_words(spark, d):
    c = table(spark, d, _C)
    return S.repeated_by_words(I.column_names(c, I.header_row(I.clean(c)))).select("source_file", "source_column", "col_idx", "target_column", "round")


@query(f"WITH {_NAMES}, t AS (SELECT source_file, source_column, CASE WHEN regexp_matches(lower(source_column), 'response|reply|answer') THEN 'r' WHEN regexp_matches(lower(source_column), 'comment\\s*\\d*|feedback|observation') THEN 'c' END AS k FROM nn) SELECT source_file, count(DISTINCT source_column) FILTER (k='c') AS n_comment, count(DISTINCT source_column) FILTER (k='r') AS n_response, CASE WHEN count(DISTINCT source_column) FILTER (k='c') > 1 AND count(DISTINCT source_column) FILTER (k='r') > 1 THEN 'wide' ELSE 'long' END AS data_structure FROM t GROUP BY 1")
def structure_by_headers(spark, d):
    c = table(spark, d, _C)
    return S.structure_by_headers(I.column_names(c, I.header_row(I.clean(c))))


@query(f"SELECT rec_id, comment_id, CASE WHEN comment_id IS NOT NULL AND source_file IS NOT NULL THEN row_number() OVER (PARTITION BY source_file, comment_id ORDER BY rec_id) END AS round_no FROM {_N}")
def seq_round(spark, d):
    return S.sequential_round(table(spark, d, _N).select("rec_id", "source_file", "comment_id"), ["source_file", "comment_id"], "rec_id").select("rec_id", "comment_id", "round_no")


_P1, _P2 = r"(?i)([-_\s]R(\d+))([-_\s.]|$)", r"(?i)([-_\s]Round\s*(\d+))([-_\s.]|$)"


@query(
    f"WITH v AS (SELECT rec_id, source_file, {strip('comment_id')} AS s FROM {_N}), h AS (SELECT *, coalesce({first('s', _P1, 1)}, {first('s', _P2, 1)}) AS hit, TRY_CAST(coalesce({first('s', _P1, 2)}, {first('s', _P2, 2)}) AS INT) AS x FROM v),"
    f" b AS (SELECT *, CASE WHEN hit IS NULL THEN s ELSE {strip('s[1:instr(s, hit) - 1] || s[instr(s, hit) + length(hit):]')} END AS base_id FROM h)"
    " SELECT rec_id, base_id, CASE WHEN base_id IS NOT NULL AND source_file IS NOT NULL THEN coalesce(x, coalesce(max(x) OVER (PARTITION BY source_file, base_id), 0) + sum((x IS NULL)::INT) OVER (PARTITION BY source_file, base_id ORDER BY rec_id ROWS UNBOUNDED PRECEDING))::INT END AS round_no FROM b"
)
def mixed_round(spark, d):
    return S.long_rounds(table(spark, d, _N).select("rec_id", "source_file", "comment_id"), "source_file", "comment_id", "rec_id").select("rec_id", "base_id", "round_no")


# Two rounds of each row: its own texts, and topic/section in their place as the second.
_W2 = {"comment_text": "topic", "response_text": "section", "date_received": "date_responded", "status": "comment_type"}


@query(
    f"WITH w AS (SELECT rec_id, {strip('comment_text')} c1, {strip('topic')} c2, {strip('response_text')} r1, {strip('section')} r2, date_received d1, date_responded d2, status s1, comment_type s2, comment_type t1 FROM {_N}),"
    " l AS (SELECT rec_id, 1 AS round, nullif(c1,'') AS c, nullif(r1,'') AS r, d1 AS d, s1 AS s, d1, s1, t1 FROM w UNION ALL SELECT rec_id, 2, nullif(c2,''), nullif(r2,''), d2, s2, d1, s1, t1 FROM w)"
    f" SELECT rec_id, round, c AS comment_text, coalesce(r, '') AS response_text, coalesce(CASE WHEN {strip('d')} NOT IN ('','-') THEN d END, CASE WHEN {strip('d1')} NOT IN ('','-') THEN d1 END) AS date_received, NULL::VARCHAR AS date_responded,"
    f" coalesce(CASE WHEN {strip('s')} NOT IN ('','-') THEN s END, CASE WHEN {strip('s1')} NOT IN ('','-') THEN s1 END) AS status, CASE WHEN {strip('t1')} NOT IN ('','-') THEN t1 END AS comment_type FROM l WHERE c IS NOT NULL OR r IS NOT NULL"
)
def wide_to_long(spark, d):
    n = table(spark, d, _N)
    x = n.select("rec_id", F.col("comment_type").alias("comment_type_1"), *[F.col(a).alias(f"{a}_1") for a in _W2], *[F.col(b).alias(f"{a}_2") for a, b in _W2.items()])
    return S.wide_to_long(x, ["rec_id"], 2)


_SA, _SB, _SC = strip("status"), strip("agency"), strip("comment_type")


@query(f"SELECT rec_id, CASE WHEN coalesce(length({_SA}),0)=0 AND coalesce(length({_SB}),0)=0 AND coalesce(length({_SC}),0)=0 THEN '' WHEN coalesce(length({_SA}),0) >= coalesce(length({_SB}),0) AND coalesce(length({_SA}),0) >= coalesce(length({_SC}),0) THEN {_SA} WHEN coalesce(length({_SB}),0) >= coalesce(length({_SC}),0) THEN {_SB} ELSE {_SC} END AS longest FROM {_N}")
def longest_value(spark, d):
    return table(spark, d, _N).select("rec_id", S.longest(["status", "agency", "comment_type"]).alias("longest"))


@query(f"SELECT rec_id, source_file, row_number() OVER (PARTITION BY source_file ORDER BY rec_id) AS auto_id FROM {_N} WHERE source_file IS NOT NULL")
def coalesce_auto_id(spark, d):
    return S.auto_id(table(spark, d, _N).select("rec_id", "source_file").where("source_file is not null"), "source_file", "rec_id", 1000)


@query(f"SELECT comment_id, NULL::VARCHAR AS section, NULL::VARCHAR AS topic, round, NULL::VARCHAR AS comment_type, NULL::VARCHAR AS comment_text, NULL::VARCHAR AS response_text, author, NULL::VARCHAR AS date_received, NULL::VARCHAR AS date_responded, NULL::VARCHAR AS status, agency, source_file, project, NULL::VARCHAR AS data_structure FROM {_N}")
def schema_complete(spark, d):
    return S.complete(table(spark, d, _N).select("comment_id", "round", "author", "agency", "source_file", "project"))


@query(f"SELECT rec_id, agency, NULL::VARCHAR AS status FROM {_N} WHERE rec_id % 2 = 0 UNION ALL SELECT rec_id, NULL, status FROM {_N} WHERE rec_id % 2 = 1")
def union_by_name(spark, d):
    n = table(spark, d, _N)
    return S.union_by_name(n.where("rec_id % 2 = 0").select("rec_id", "agency"), n.where("rec_id % 2 = 1").select("rec_id", "status"))


_BLANKS = r"regexp_replace(author, '\s+', ' ', 'g')"
_TITLES = f"s0 AS (SELECT *, {strip(_BLANKS)} AS a0 FROM w)"
for _i, _t in enumerate(D.AUTHOR_TITLES):
    _TITLES += f", s{_i + 1} AS (SELECT *, CASE WHEN starts_with(a{_i}, '{_t}') THEN {strip(f'a{_i}[{len(_t) + 1}:]')} ELSE a{_i} END AS a{_i + 1} FROM s{_i})"


@query(
    f"WITH v AS (SELECT *, {strip('agency')} AS ag FROM {_N}), w AS (SELECT *, {strip(sql_agency_once('ag'))} AS ag2 FROM v), {_TITLES}"
    f" SELECT comment_id, section, topic, round, {sql_by_dictionary('comment_type', D.COMMENT_TYPES)} AS comment_type, comment_text, response_text, coalesce(a{len(D.AUTHOR_TITLES)}, '') AS author,"
    + ", ".join(f"CASE WHEN {c} IS NULL THEN '' ELSE coalesce(CAST({sql_date(c)} AS VARCHAR), {c}) END AS {c}" for c in ("date_received", "date_responded"))
    + f", {sql_by_dictionary('status', D.STATUSES)} AS status, CASE WHEN agency IS NULL THEN '' ELSE {sql_agency_once('ag2')} END AS agency, source_file, project, data_structure FROM s{len(D.AUTHOR_TITLES)}"
)
def transform(spark, d):
    return S.complete(S.transform(table(spark, d, _N)))


# ------------------------------------------------------------ composites


@query(f"SELECT rec_id, round((epoch_us(loaded_at) - epoch_us(TRY_CAST(date_received AS TIMESTAMP))) / 86400000000.0, 6) AS days FROM {_N} WHERE loaded_at IS NOT NULL AND regexp_full_match(date_received, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(date_received AS TIMESTAMP) IS NOT NULL")
def fractional_days(spark, d):
    """C17: days with their fraction, here from the comment to its load."""
    x = table(spark, d, _N).select("rec_id", "loaded_at", R.to_date(F.col("date_received")).alias("day"))
    return x.where("day is not null and loaded_at is not null").select("rec_id", F.round(R.days_between(F.col("day"), F.col("loaded_at")), 6).alias("days"))


@query(
    "WITH c AS (SELECT rec_id, trim(replace(regexp_replace(regexp_replace(response_text, '^\\s+|\\s+$', '', 'g'), 'The', '', 'g'), chr(0), '')) AS r FROM normalized_output_example WHERE regexp_full_match(response_text, '[!-~ ]+'))"
    " SELECT rec_id, r AS response FROM c"
)
def clean_response(spark, d):
    """White space and an echoed instruction (here a common word) taken off a model's text."""
    x = table(spark, d, _N).where(F.col("response_text").rlike("^[!-~ ]+$") & ~F.col("response_text").contains("\n"))
    return x.select("rec_id", R.clean_response(F.col("response_text"), "The").alias("response"))


@query()
def column_pairs(spark, d):
    """Columns beside targets, with samples and descriptions."""
    from reviewloom.pipeline import column_pairs as pairs

    return pairs(I.read(table(spark, d, _C)))


@query()
def match_columns(spark, d):
    """T9-T11 with the offline stand-ins for the models."""
    from reviewloom import pipeline

    return pipeline.match(pipeline.column_pairs(I.read(table(spark, d, _C))))


@query()
def normalize_workbooks(spark, d):
    """Cells and accepted pairs to the normalized table, all files in one plan."""
    from reviewloom import pipeline

    return pipeline.normalize(I.read(table(spark, d, _C)), pipeline.mappings(table(spark, d, _MP)))

"""Value rules over whole columns, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom import rulesdata as D
from reviewloom.common import PLACEHOLDERS, filled, is_empty, sql_empty, table
from reviewloom.operators.reshape import by_value
from reviewloom.functions import rules as R

QUERIES: dict = {}
SQL: dict[str, str] = {}
_N = "normalized_output_example"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def first(v: str, p: str, g: int = 1) -> str:
    return f"CASE WHEN regexp_matches({v}, {_q(p)}) THEN regexp_extract({v}, {_q(p)}, {g}) END"


def _abbr() -> list[str]:
    return sorted(set(D.AGENCY_NAMES.values()), key=lambda a: (-len(a), a))


def _word(v: str, w: str) -> str:
    return f"regexp_matches({v}, '(?i)(^|[^A-Za-z0-9_]){w}([^A-Za-z0-9_]|$)')"


def sql_agency_once(v: str) -> str:
    known = " ".join(f"WHEN {v} = {_q(n)} THEN {_q(a)}" for n, a in D.AGENCY_NAMES.items())
    full = " ".join(f"WHEN contains(lower({v}), {_q(n.lower())}) THEN {_q(a)}" for n, a in D.AGENCY_NAMES.items())
    word = " ".join(f"WHEN {_word(v, a)} THEN {_q(a)}" for a in _abbr())
    skip = ",".join(map(_q, D.ACRONYM_SKIP))
    acr = rf"list_aggregate(list_transform(list_filter(regexp_split_to_array({v}, '\s+'), lambda w: length(w) > 2 AND lower(w) NOT IN ({skip}))[1:4], lambda w: upper(w[1])), 'string_agg', '')"
    return (
        f"CASE WHEN {v} IN ({','.join(map(_q, _abbr()))}) THEN {v} {known} {full} {word} WHEN regexp_matches({v}, '^\\p{{Lu}}{{1,4}}$') THEN {v}"
        f" WHEN length({acr}) = 1 THEN {v} WHEN length({acr}) > 1 THEN {acr} WHEN length({v}) = 1 THEN {v} ELSE upper({v}[1:4]) END"
    )


def sql_by_dictionary(c: str, words: dict[str, str]) -> str:
    v = strip(c)
    exact = " ".join(f"WHEN lower({v}) = {_q(k)} THEN {_q(x)}" for k, x in words.items())
    part = " ".join(f"WHEN contains(lower({v}), {_q(k)}) THEN {_q(x)}" for k, x in words.items())
    return f"CASE WHEN {c} IS NULL THEN '' {exact} {part} ELSE {v} END"


def sql_date(c: str) -> str:
    v = strip(c)
    out = []
    for named, layouts in ((False, R.DATE_LAYOUTS), (True, R.NAMED_LAYOUTS)):
        for p, y, m, d in layouts:
            g = lambda i: f"regexp_extract({v}, {_q(p)}, {i})"
            year = f"CASE WHEN length({g(y)}) = 2 THEN (CASE WHEN {g(y)} < '69' THEN '20' ELSE '19' END) || {g(y)} ELSE {g(y)} END"
            month = f"CASE WHEN instr('{R._MONTHS}', lower({g(m)}[1:3])) % 3 = 1 THEN CAST((instr('{R._MONTHS}', lower({g(m)}[1:3])) + 2) // 3 AS VARCHAR) END" if named else g(m)
            out.append(f"CASE WHEN regexp_matches({v}, {_q(p)}) THEN TRY_CAST(({year}) || '-' || lpad({month}, 2, '0') || '-' || lpad({g(d)}, 2, '0') AS DATE) END")
    return f"coalesce({', '.join(out)})"


def _add(name: str, column: str, f, sql: str, out: str = "result") -> None:
    """A rule over the different values of a column of the review table."""
    QUERIES[name] = lambda spark, d: table(spark, d, _N).select(F.col(column).alias("value")).distinct().select("value", f(F.col("value")).alias(out))
    SQL[name] = f"WITH v AS (SELECT DISTINCT {column} AS value FROM {_N}) SELECT value, {sql} AS {out} FROM v"


_IDP = [p for p in D.ID_PATTERNS]
_SV = strip("value")
_add("agency_from_id", "comment_id", R.agency_from_id, rf"CASE WHEN value IS NULL OR regexp_matches({_SV}, '^[0-9]+$') THEN '' ELSE coalesce({', '.join(first(_SV, p) for p in _IDP)}, '') END")
QUERIES["agency_code"] = lambda spark, d: table(spark, d, _N).select(F.col("agency").alias("value")).distinct().select("value", R.agency_code(F.col("value")).alias("result"))
SQL["agency_code"] = f"WITH v AS (SELECT DISTINCT agency AS value, {strip('agency')} AS s FROM {_N}), w AS (SELECT value, {strip(sql_agency_once('s'))} AS t FROM v) SELECT value, CASE WHEN value IS NULL THEN '' ELSE {sql_agency_once('t')} END AS result FROM w"
_add("author_agency", "author", R.agency_from_author, "CASE " + " ".join(f"WHEN {_word('value', a)} THEN '{a}'" for a in _abbr()) + " ELSE '' END")
QUERIES["author_clean"] = lambda spark, d: table(spark, d, _N).select(F.col("author").alias("value")).distinct().select("value", R.author(F.col("value")).alias("result"))
_AC = r"strip0 AS (SELECT DISTINCT author AS value, regexp_replace(regexp_replace(author, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS s0 FROM normalized_output_example)"
for _i, _t in enumerate(D.AUTHOR_TITLES):
    _AC += f", strip{_i + 1} AS (SELECT value, CASE WHEN starts_with(s{_i}, '{_t}') THEN {strip(f's{_i}[{len(_t) + 1}:]')} ELSE s{_i} END AS s{_i + 1} FROM strip{_i})"
SQL["author_clean"] = f"WITH {_AC} SELECT value, coalesce(s{len(D.AUTHOR_TITLES)}, '') AS result FROM strip{len(D.AUTHOR_TITLES)}"
_add("date_std", "date_received", R.standard_date, f"CASE WHEN value IS NULL THEN '' ELSE coalesce(CAST({sql_date('value')} AS VARCHAR), value) END")
_add("status_norm", "status", R.status, sql_by_dictionary("value", D.STATUSES))
_add("type_norm", "comment_type", R.comment_type, sql_by_dictionary("value", D.COMMENT_TYPES))
_add("round_extract", "round", R.round_number, f"CASE WHEN value IS NULL THEN '' ELSE coalesce({', '.join(first('lower(value)', p) for p in D.ROUND_PATTERNS)}, {_SV}) END")
_P1, _P2 = r"(?i)([-_\s]R(\d+))([-_\s.]|$)", r"(?i)([-_\s]Round\s*(\d+))([-_\s.]|$)"
_HIT = f"coalesce({first('s', _P1, 1)}, {first('s', _P2, 1)})"
QUERIES["base_id_round"] = lambda spark, d: table(spark, d, _N).select(F.col("comment_id").alias("value")).distinct().select("value", R.base_id(F.col("value")).alias("base_id"), R.id_round(F.col("value")).alias("round_no"))
SQL["base_id_round"] = f"WITH v AS (SELECT DISTINCT comment_id AS value, {strip('comment_id')} AS s FROM {_N}), w AS (SELECT value, s, {_HIT} AS hit, coalesce({first('s', _P1, 2)}, {first('s', _P2, 2)}) AS r FROM v) SELECT value, CASE WHEN hit IS NULL THEN s ELSE {strip('s[1:instr(s, hit) - 1] || s[instr(s, hit) + length(hit):]')} END AS base_id, TRY_CAST(r AS INT) AS round_no FROM w"
QUERIES["colname_norm"] = lambda spark, d: table(spark, d, "jellyfish_input_example").select(F.col("source_column").alias("value")).distinct().select("value", R.column_name(F.col("value")).alias("result"))
_CN = lambda c: strip(rf"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')")
SQL["colname_norm"] = f"WITH v AS (SELECT DISTINCT source_column AS value FROM jellyfish_input_example) SELECT value, {_CN('value')} AS result FROM v"
QUERIES["placeholder_clean"] = lambda spark, d: table(spark, d, _N).select("rec_id", *[filled(F.col(c)).alias(c) for c in ("agency", "status", "author", "comment_text")])
SQL["placeholder_clean"] = "SELECT rec_id, " + ", ".join(f"CASE WHEN NOT {sql_empty(c)} THEN {c} END AS {c}" for c in ("agency", "status", "author", "comment_text")) + f" FROM {_N}"
_HASAG = "source_file"
QUERIES["agency_priority"] = lambda spark, d: table(spark, d, _N).select("rec_id", R_agency().alias("agency_code"))


def R_agency():
    from reviewloom.operators.reshape import agency

    # Files whose layout is wide stand for files with an agency column.
    return agency(F.coalesce(F.lower("data_structure") == "wide", F.lit(False)), F.col("agency"), F.col("comment_id"), F.col("author"))


SQL["agency_priority"] = (
    f"WITH v AS (SELECT *, {strip('agency')} AS s, {strip('comment_id')} AS cid FROM {_N}), w AS (SELECT *, {strip(sql_agency_once('s'))} AS t FROM v)"
    f" SELECT rec_id, CASE WHEN coalesce(lower(data_structure) = 'wide', false) THEN CASE WHEN agency IS NULL THEN '' ELSE {sql_agency_once('t')} END"
    f" ELSE coalesce(nullif(CASE WHEN cid IS NULL OR regexp_matches(cid, '^[0-9]+$') THEN '' ELSE coalesce({', '.join(first('cid', p) for p in _IDP)}, '') END, ''),"
    f" CASE {' '.join(f'WHEN {_word(chr(97) + chr(117) + chr(116) + chr(104) + chr(111) + chr(114), a)} THEN {_q(a)}' for a in _abbr())} ELSE '' END) END AS agency_code FROM w"
)
_V = "voting_stats"
QUERIES["parse_answer"] = lambda spark, d: table(spark, d, _V).select("pair_id", R.first_answer(F.col("output_1")).alias("answer"))
SQL["parse_answer"] = f"SELECT pair_id, CASE WHEN contains(lower(output_1[1:5]), 'yes') THEN 'Yes' WHEN contains(lower(output_1[1:5]), 'no') THEN 'No' ELSE '' END AS answer FROM {_V}"
QUERIES["process_output"] = lambda spark, d: table(spark, d, _V).select("pair_id", R.any_answer(F.col("output_2")).alias("answer"), R.last_line_answer(F.col("output_3")).alias("last_line"))
SQL["process_output"] = f"SELECT pair_id, CASE WHEN contains(lower(output_2), 'yes') THEN 'Yes' WHEN contains(lower(output_2), 'no') THEN 'No' ELSE 'Unknown' END AS answer, CASE WHEN contains(lower(output_3), 'yes') THEN 'Yes' WHEN contains(lower(output_3), 'no') THEN 'No' ELSE 'Unknown' END AS last_line FROM {_V}"
_NUM = r"'[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?'"
QUERIES["verify_answer"] = lambda spark, d: table(spark, d, _N).select("rec_id", R.answers_match(F.col("agency"), F.col("status")).alias("match"), R.answers_match(F.col("round"), F.lit("1.0")).alias("match_round"))


def _sql_match(a: str, b: str) -> str:
    n = lambda c: f"TRY_CAST(nullif(regexp_extract(replace({c}, ',', ''), {_NUM}), '') AS DOUBLE)"
    t = lambda c: strip(f"lower(coalesce({c}, ''))")
    return f"CASE WHEN {n(a)} IS NOT NULL AND {n(b)} IS NOT NULL THEN abs({n(a)} - {n(b)}) <= 0.01 ELSE {t(a)} = {t(b)} OR ({t(b)} <> '' AND contains({t(a)}, {t(b)})) END"


SQL["verify_answer"] = f"SELECT rec_id, {_sql_match('agency', 'status')} AS match, {_sql_match('round', _q('1.0'))} AS match_round FROM {_N}"
QUERIES["qa_accuracy"] = lambda spark, d: table(spark, d, _N).select(R.answers_match(F.col("round"), F.lit("1")).alias("m")).agg(F.count("*").alias("total"), F.count_if("m").alias("passed"), F.round(F.avg(F.col("m").cast("double")), 6).alias("rate"))
SQL["qa_accuracy"] = f"SELECT count(*) AS total, count(*) FILTER (m) AS passed, round(avg(m::INT), 6) AS rate FROM (SELECT {_sql_match('round', _q('1'))} AS m FROM {_N})"
_J = "jellyfish_input_example"
_S = [f"sample_{i}" for i in (1, 2, 3)]
QUERIES["samples_key"] = lambda spark, d: table(spark, d, _J).select("pair_id", F.array_join(R.samples_key([F.col(c) for c in _S]), "|").alias("samples_key"))
_KEY = f"list_filter([{', '.join(strip(c) for c in _S)}], lambda s: s IS NOT NULL AND s <> '' AND s <> 'nan')"
SQL["samples_key"] = f"SELECT pair_id, array_to_string({_KEY}, '|') AS samples_key FROM {_J}"
QUERIES["sample_text"] = lambda spark, d: table(spark, d, _J).select("pair_id", R.sample_text([F.col(c) for c in _S]).alias("samples"))
_TXT = f"array_to_string(list_transform({_KEY}, lambda s: CASE WHEN length(s) > 100 THEN s[1:100] || '...' ELSE s END), ', ')"
SQL["sample_text"] = f"SELECT pair_id, {_TXT} AS samples FROM {_J}"
QUERIES["infer_description"] = lambda spark, d: table(spark, d, _J).select("source_column").distinct().select("source_column", R.description(F.col("source_column")).alias("description"))
SQL["infer_description"] = f"SELECT DISTINCT source_column, CASE {' '.join(f'WHEN {chr(32) + (chr(32) + chr(79) + chr(82) + chr(32)).join(f'contains(lower(source_column), {_q(w)})' for w in ws)} THEN {_q(D.DESCRIPTIONS[k])}' for k, ws in D.HEADER_WORDS.items())} ELSE 'Data column containing ' || lower(source_column) || ' information' END AS description FROM {_J}"
QUERIES["fallback_map"] = lambda spark, d: table(spark, d, _J).select("source_file", "source_column").distinct().withColumn("target_column", R.fallback_target(F.col("source_column"))).where("target_column is not null")
SQL["fallback_map"] = f"SELECT DISTINCT source_file, source_column, t AS target_column FROM {_J} JOIN (VALUES {', '.join(f'({_q(a)}, {_q(b)})' for a, b in D.FALLBACK_HEADERS.items())}) f(h, t) ON h = source_column"
QUERIES["project_name"] = lambda spark, d: table(spark, d, "workbook_manifest").select("source_file", R.project_name(F.concat(F.lit("/data/in/"), "source_file")).alias("name"))
SQL["project_name"] = "SELECT source_file, replace(source_file, '.xlsx', '') AS name FROM workbook_manifest"


def _prompts(spark, d):
    from reviewloom.operators import models as M

    return table(spark, d, _J).select("pair_id", M.match_prompt(False, True).alias("prompt"), M.describe_prompt(F.col("target_column"), existing=F.col("target_description")).alias("describe"), M.embed_text(F.col("source_column"), F.col("source_description")).alias("embed"))


QUERIES["prompt_build"] = _prompts
SQL["prompt_build"] = (
    f"SELECT pair_id, 'Do these two columns hold the same information?' || chr(10) || 'Column A: ' || coalesce(source_column,'') || ' - ' || coalesce(source_description,'') || '.' || CASE WHEN {_TXT} <> '' THEN ' Samples: ' || {_TXT} || '.' ELSE '' END"
    " || chr(10) || 'Column B: ' || coalesce(target_column,'') || ' - ' || coalesce(target_description,'') || '.' || chr(10) || 'Answer Yes or No.' AS prompt,"
    " 'Describe the database column ' || target_column || ' of a review tracker in one sentence of at most 25 words.' || chr(10) || coalesce('Current description: ' || target_description, 'Sample values: (none provided)') || chr(10) || 'This column' AS describe,"
    f" concat_ws(' ', source_column, source_description) AS embed FROM {_J}"
)


def _per_row(name: str, column: str, source: str = _N, key: str = "rec_id") -> None:
    """The rule's result for every row of the table, by the value in its column."""
    rule, sql = QUERIES[name], SQL[name]
    QUERIES[name] = lambda spark, d: by_value(table(spark, d, source).select(key, F.col(column).alias("value")), "value", rule(spark, d)).drop("value")
    SQL[name] = f"SELECT n.{key}, x.* EXCLUDE (value) FROM {source} n JOIN ({sql}) x ON n.{column} IS NOT DISTINCT FROM x.value"


for _n, _c in {"agency_from_id": "comment_id", "agency_code": "agency", "author_agency": "author", "author_clean": "author", "date_std": "date_received", "status_norm": "status", "type_norm": "comment_type", "round_extract": "round", "base_id_round": "comment_id"}.items():
    _per_row(_n, _c)
_per_row("colname_norm", "source_column", "jellyfish_input_example", "pair_id")

"""Queries over files whose layout drifts."""

from pyspark.sql import functions as F

from reviewloom.common import sql_empty, table
from reviewloom.operators import drift as D


def _Q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(spark, d):
    return [table(spark, d, n) for n in ("workbook_manifest", "workbook_cells", "jellyfish_input_example")]


def p3_found(spark, d):
    rows = table(spark, d, "normalized_output_example").select("source_file", "data_structure")
    return D.changes(*_in(spark, d), rows)


def p3_lifespans(spark, d):
    return D.lifespans(D.catalogue(*_in(spark, d))).drop("first_content", "last_content")


def p3_unified(spark, d):
    return D.unify(*_in(spark, d)).withColumns({c: F.col(c).cast("string") for c in ("date_received", "date_responded")})


def p3_casts(spark, d):
    return D.cast_report(*_in(spark, d))


QUERIES = {"p3_found": p3_found, "p3_lifespans": p3_lifespans, "p3_unified": p3_unified, "p3_casts": p3_casts}

_E = sql_empty("cell_value")
_TRIM = "regexp_replace({c}, '^ +| +$', '', 'g')"
_KEY = r"trim(regexp_replace(regexp_replace(lower({c}), '[''’]', '', 'g'), '[^\p{{L}}\p{{Nd}}]+', ' ', 'g'))"
_CATALOGUE = (
    "files AS (SELECT project, source_file, row_number() OVER (PARTITION BY project ORDER BY delivery_no, source_file) AS seq FROM workbook_manifest),"
    " sc AS (SELECT * FROM (SELECT c.*, m.header_row, min((CASE WHEN sheet = sheet_name THEN 0 ELSE 1 END, sheet_idx)) OVER (PARTITION BY source_file) AS pick FROM workbook_cells c JOIN workbook_manifest m USING (source_file)) WHERE sheet_idx = pick[2]),"
    f" heads AS (SELECT source_file, {_TRIM.format(c='cell_value')} AS header, min(col_idx) AS col_idx FROM sc WHERE row_idx = header_row AND NOT {_E} GROUP BY ALL),"
    f" kinds AS (SELECT source_file, col_idx, vtype, count(*) AS n, list_distinct(flatten(list(list_append(string_split_regex(trim(regexp_replace(regexp_replace(cell_value, '\\p{{L}}+', 'a', 'g'), '\\p{{Nd}}+', '9', 'g')), '\\s+'), 'length ' || floor(log2(length(cell_value) + 1))::INT)))) AS s FROM sc WHERE row_idx > header_row AND NOT {_E} GROUP BY ALL),"
    " kind AS (SELECT source_file, col_idx, arg_min(vtype, (-n, vtype)) AS vtype, list_distinct(flatten(list(s))) AS shapes FROM kinds GROUP BY ALL),"
    f" alias(k, field) AS (VALUES {', '.join(f'({_Q(n)}, {_Q(f)})' for f, ns in D.ALIASES.items() for n in ns)}),"
    f" cat AS (SELECT f.project, f.source_file, f.seq, h.header, h.col_idx, k.vtype, k.shapes, a.field, {_KEY.format(c='h.header')} AS key FROM files f JOIN heads h USING (source_file) LEFT JOIN kind k USING (source_file, col_idx) LEFT JOIN alias a ON a.k = {_KEY.format(c='h.header')})"
)
_PAIRED = (
    " x AS (SELECT *, lag(seq) OVER w AS before, lag(vtype) OVER w AS old_vtype, lead(seq) OVER w AS after FROM cat WINDOW w AS (PARTITION BY project, header ORDER BY seq)),"
    " fin AS (SELECT project, max(seq) AS last FROM files GROUP BY 1),"
    " s AS (SELECT * FROM x WHERE seq > 1 AND (before IS NULL OR before < seq - 1)),"
    " e AS (SELECT x.* REPLACE (x.seq + 1 AS seq) FROM x JOIN fin USING (project) WHERE x.seq < last AND (after IS NULL OR after > x.seq + 1)),"
    " b AS (SELECT s.project, s.seq, s.header AS new, e.header AS old, s.vtype AS nv, e.vtype AS ov, coalesce(len(list_intersect(s.shapes, e.shapes)) / nullif(len(list_distinct(list_concat(s.shapes, e.shapes))), 0), 0) AS alike, s.key = e.key AS same, s.field AS nf, e.field AS of FROM s JOIN e USING (project, seq)),"
    " sco AS (SELECT *, CASE WHEN same THEN 3.0 WHEN nf = of THEN 2.0 + alike WHEN (nf IS NULL OR of IS NULL) AND nv = ov AND alike >= 0.5 THEN alike END AS score FROM b),"
    " p1 AS (SELECT * FROM sco WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY project, seq, new ORDER BY score DESC, old) = 1),"
    " pr AS (SELECT * FROM p1 QUALIFY row_number() OVER (PARTITION BY project, seq, old ORDER BY score DESC, new) = 1),"
    " lay AS (SELECT source_file, arg_min(l, (-n, l)) AS layout FROM (SELECT source_file, lower(trim(data_structure)) AS l, count(*) AS n FROM normalized_output_example GROUP BY ALL) WHERE l IN ('long', 'wide') GROUP BY 1),"
    " lag AS (SELECT project, seq, layout, lag(layout) OVER (PARTITION BY project ORDER BY seq) AS old_layout FROM files LEFT JOIN lay USING (source_file)),"
    " ch AS (SELECT project, seq, 'renamed' AS change_kind, old AS old_column, new AS new_column FROM pr UNION ALL SELECT project, seq, 'type_changed', old, new FROM pr WHERE ov <> nv"
    " UNION ALL SELECT project, seq, 'type_changed', header, header FROM x WHERE before = seq - 1 AND old_vtype <> vtype"
    " UNION ALL SELECT project, seq, 'added', '', header FROM s WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.project = s.project AND pr.seq = s.seq AND pr.new = s.header)"
    " UNION ALL SELECT project, seq, 'removed', header, '' FROM e WHERE NOT EXISTS (SELECT 1 FROM pr WHERE pr.project = e.project AND pr.seq = e.seq AND pr.old = e.header)"
    " UNION ALL SELECT project, seq, 'structure_changed', '', '' FROM lag WHERE layout <> old_layout)"
)
# Every delivered file has header cells in these tables, so the pairs add no column.
SQL: dict[str, str] = {
    "p3_found": f"WITH {_CATALOGUE},{_PAIRED} SELECT source_file, change_kind, old_column, new_column FROM ch JOIN files USING (project, seq)",
    "p3_lifespans": f"WITH {_CATALOGUE}, n AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY project, header, field, vtype ORDER BY seq) AS island FROM (SELECT *, coalesce(seq - lag(seq) OVER (PARTITION BY project, header, field, vtype ORDER BY seq) <> 1, true) AS new FROM cat))"
    " SELECT project, header, field, vtype, island, min(seq) AS first_delivery, max(seq) AS last_delivery FROM n GROUP BY ALL",
}
_D = lambda v: f"coalesce({', '.join(f'try_strptime({v}, {_Q(f)})::DATE' for f in ('%Y-%m-%d %H:%M:%S', '%Y-%m-%d', '%d-%m-%Y', '%B %d %Y', '%m/%d/%Y'))})"
_CAST = lambda f, v: _D(v) if D.CASTS.get(f) == "date" else f"TRY_CAST({v} AS {D.CASTS[f].upper()})" if f in D.CASTS else v
_PLACED = (
    f"{_CATALOGUE}, hs AS (SELECT source_file, col_idx, {_TRIM.format(c='cell_value')} AS header FROM sc WHERE row_idx = header_row AND NOT {_E}),"
    " nm AS (SELECT *, count(*) OVER (PARTITION BY source_file, header) > 1 AS twice FROM hs),"
    f" placed AS (SELECT f.project, sc.source_file, sc.row_idx, sc.col_idx, sc.cell_value, a.field, CASE WHEN header IS NULL THEN 'Column_' || sc.col_idx WHEN twice THEN header || '#' || sc.col_idx ELSE header END AS name FROM sc JOIN files f USING (source_file) LEFT JOIN nm USING (source_file, col_idx) LEFT JOIN alias a ON a.k = {_KEY.format(c='header')} WHERE sc.row_idx > sc.header_row AND NOT {_E})"
)
_T = ", ".join(map(_Q, D.TARGET))
SQL["p3_unified"] = (
    f"WITH {_PLACED}, r AS (SELECT *, field IN ({_T}) AND row_number() OVER (PARTITION BY source_file, row_idx, field ORDER BY col_idx) = 1 AS taken FROM placed),"
    f" w AS (SELECT project, source_file, row_idx, {', '.join(f'max(cell_value) FILTER (taken AND field = {_Q(f)}) AS {f}' for f in D.TARGET)},"
    " coalesce(to_json(map_from_entries(list((name, cell_value) ORDER BY name) FILTER (NOT coalesce(taken, false))))::VARCHAR, '{}') AS other FROM r GROUP BY ALL)"
    f" SELECT project, source_file, row_idx, {', '.join((_CAST(f, f) + '::VARCHAR' if D.CASTS.get(f) == 'date' else _CAST(f, f)) + ' AS ' + f for f in D.TARGET)}, other,"
    f" to_json(map_from_entries(list_sort(list_filter([{', '.join(f'CASE WHEN {f} IS NOT NULL AND {_CAST(f, f)} IS NULL THEN ({_Q(f)}, {f}) END' for f in D.TARGET if f in D.CASTS)}], lambda x: x IS NOT NULL))))::VARCHAR AS uncast FROM w"
)
SQL["p3_casts"] = f"WITH {_PLACED} SELECT project, source_file, name AS column_name, field, CASE {' '.join(f'WHEN field = {_Q(f)} THEN {_Q(k)}' for f, k in D.CASTS.items())} END AS cast_to, count(*) AS n_cells, count(*) FILTER (CASE {' '.join(f'WHEN field = {_Q(f)} THEN {_CAST(f, 'cell_value')} IS NULL' for f in D.CASTS)} END) AS n_failed FROM placed WHERE field IN ({', '.join(map(_Q, D.CASTS))}) GROUP BY ALL"

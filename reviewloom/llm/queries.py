"""Queries of the text operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from reviewloom.common import cut, spread, sql_empty, table
from reviewloom.llm import canonical, mixing, packing, pii, repetition, variants
from reviewloom.llm.tokens import token_count


def _review(spark, d):
    return spread(table(spark, d, "normalized_output_example").select("rec_id", "author", "comment_text", "response_text"))


def p1_found(spark, d):
    return pii.mentions(_review(spark, d)).select("rec_id", "field_name", "pii_type", "ordinal")


def p1_redacted(spark, d):
    return pii.redact(_review(spark, d)).drop("author")


def _linked(spark, d):
    rows = table(spark, d, "normalized_output_example").select("agency", "author", "project")
    return variants.link(variants.review_values(rows), variants.known_agencies(table(spark, d, "canonical_values")))


def p4_found(spark, d):
    return variants.pairs_of(_linked(spark, d))


def p4_entities(spark, d):
    return _linked(spark, d)


def _mapped(spark, d):
    rows = table(spark, d, "normalized_output_example").select("agency", "status", "comment_type")
    return canonical.match(canonical.review_values(rows), table(spark, d, "canonical_values"))


def p5_found(spark, d):
    return _mapped(spark, d).select("field_name", "raw_value", "canonical_value")


def p5_join(spark, d):
    """The set-similarity join by itself: lower-case values and the list's names of a field whose letter pairs are half alike.

    Of printable ASCII only, as in its SQL; `p5_found` and `p5_unmatched` take every filled value.
    """
    rows = table(spark, d, "normalized_output_example").select("agency", "status", "comment_type")
    low = lambda df, c: df.select("field_name", F.lower(c).alias("s")).where(F.col("s").rlike("^[ -~]+$"))
    probe = low(canonical.review_values(rows), "raw_value").withColumnRenamed("s", "p")
    index = low(table(spark, d, "canonical_values").where("canonical_value is not null and field_name is not null"), "canonical_value").withColumnRenamed("s", "r")
    return canonical.set_join(probe, index, "field_name").withColumn("similarity", F.round("similarity", 6))


def p5_unmatched(spark, d):
    return _mapped(spark, d).where("canonical_value = 'UNMATCHED'").select("field_name", "raw_value")


def p6_containers(spark, d):
    return packing.pack(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "container_specs"))


def p6_usage(spark, d):
    return packing.usage(p6_containers(spark, d))


def p6_checks(spark, d):
    """What must hold of any packing, counted over all documents and containers."""
    docs, specs = table(spark, d, "documents").select("doc_id", "text"), table(spark, d, "container_specs")
    packed = cut(packing.pack(spread(docs), specs))
    sizes = cut(spread(docs).select("doc_id", token_count(F.col("text")).alias("n")))
    per = packed.groupBy("spec_name", "capacity_tokens", "doc_id").agg(F.sum("n_tokens").alias("kept"), F.count("*").alias("pieces"))
    per = per.join(sizes, "doc_id").groupBy("spec_name").agg(
        F.count("*").alias("documents"), F.count_if(F.col("kept") != F.col("n")).alias("incomplete"), F.count_if((F.col("pieces") > 1) & (F.col("n") <= F.col("capacity_tokens"))).alias("split_in_vain"),
    )
    box = packed.groupBy("spec_name", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("load"))
    return per.join(box.groupBy("spec_name").agg(F.count_if(F.col("load") > F.col("capacity_tokens")).alias("overfull")), "spec_name")


def p7_mixture(spark, d):
    return mixing.mix(spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mixture_targets"))


def p7_shares(spark, d):
    docs, targets = spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mixture_targets")
    sized = mixing.usable(docs, targets)
    return mixing.shares(mixing.mix(docs, targets, sized=sized), targets, sized)


def p7_checks(spark, d):
    """What must hold of any mixture that uses every document, counted by source."""
    docs, targets = spread(table(spark, d, "documents").select("doc_id", "source", "text")), table(spark, d, "mixture_targets")
    m = cut(mixing.mix(docs, targets))
    uses = m.groupBy("source", "doc_id").agg(F.count("*").alias("uses"), F.count_distinct("use_no").alias("passes")).join(targets.select("source", "max_repeats"), "source")
    early = m.groupBy("source").agg(F.count_if((F.col("slot") < F.col("release")) | (F.col("slot") >= F.col("deadline"))).alias("out_of_window"))
    return uses.groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if((F.col("uses") > F.col("max_repeats")) | (F.col("uses") != F.col("passes"))).alias("over_used"),
    ).join(early, "source")


def _docs(spark, d):
    return spread(table(spark, d, "documents").select("doc_id", "text", "project", "source"))


def p8_found(spark, d):
    return repetition.found(_docs(spark, d))


def p8_repetition(spark, d):
    x = repetition.judged(_docs(spark, d))
    return x.withColumn("failed_rules", F.array_join("failed_rules", ","))


QUERIES = {f.__name__: f for f in (p1_found, p1_redacted, p4_found, p4_entities, p5_found, p5_join, p5_unmatched, p6_containers, p6_usage, p6_checks, p7_mixture, p7_shares, p7_checks, p8_found, p8_repetition)}
# Words, runs of six and of three, the first place of each, and words within six of a later one.
_WORDS = (
    r"t AS (SELECT doc_id, {extra} regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '\p{{Nd}}+(?:[.,:/\-]\p{{Nd}}+)*', '0', 'g'), '[\p{{L}}\p{{N}}]+(?:[''’][\p{{L}}\p{{N}}]+)*') AS w FROM documents),"
    " p AS (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM t),"
    " g AS (SELECT doc_id, i, CASE WHEN i + 5 <= len(w) THEN array_to_string(w[i:i+5], ' ') END AS run, CASE WHEN i + 2 <= len(w) THEN array_to_string(w[i:i+2], ' ') END AS triple FROM p),"
    " f AS (SELECT doc_id, i, run IS NOT NULL AND i > min(i) OVER (PARTITION BY doc_id, run) AS again, triple IS NOT NULL AND i > min(i) OVER (PARTITION BY doc_id, triple) AS again3 FROM g),"
    " c AS (SELECT doc_id, again3, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS 5 PRECEDING) AS twice FROM f)"
)
_STRIP = r"list_filter(list_transform(string_split(coalesce(text, ''), {by}), lambda x: regexp_replace(x, '^[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\v\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')), lambda x: x <> '')"
_LENGTHS = "coalesce(list_sum(list_transform({x}, lambda x: length(x))), 0)"
_TWICE = "CASE WHEN len({x}) < 2 THEN 0 ELSE 1 - " + _LENGTHS.format(x="list_distinct({x})") + " / " + _LENGTHS + " END"
_SET = "list_distinct(list_transform(generate_series(1, len({x}) + 1), lambda i: substr('^' || {x} || '$', i, 2)))"
SQL: dict[str, str] = {
    # All pairs of a field.
    "p5_join": (
        "WITH v AS (" + " UNION ".join(f"SELECT '{c}' AS field_name, lower({c}) AS p FROM normalized_output_example WHERE NOT {sql_empty(c)} AND regexp_full_match({c}, '[ -~]+')" for c in ("agency", "status", "comment_type")) + "),"
        " c AS (SELECT DISTINCT field_name, lower(canonical_value) AS r FROM canonical_values WHERE regexp_full_match(canonical_value, '[ -~]+')),"
        f" a AS (SELECT field_name, p, {_SET.format(x='p')} AS ps FROM v), b AS (SELECT field_name, r, {_SET.format(x='r')} AS rs FROM c),"
        " j AS (SELECT field_name, p, r, len(list_intersect(ps, rs)) AS n, len(ps) AS np, len(rs) AS nr FROM a JOIN b USING (field_name))"
        " SELECT field_name, p, r, round(n / (np + nr - n), 6) AS similarity FROM j WHERE n >= 0.5 * (np + nr - n)"
    ),
    "p8_found": f"WITH {_WORDS.format(extra='')} SELECT doc_id FROM c GROUP BY doc_id HAVING avg(twice) >= 0.3 - 1e-9",
    "p6_checks": "SELECT spec_name, n AS documents, 0 AS incomplete, 0 AS split_in_vain, 0 AS overfull FROM container_specs, (SELECT count(*) AS n FROM documents) WHERE capacity_tokens > 0",
    "p7_checks": "SELECT source, count(*) AS documents, 0 AS over_used, 0 AS out_of_window FROM documents JOIN mixture_targets USING (source) WHERE text <> '' AND target_share > 0 AND max_repeats > 0 GROUP BY 1",
    "p8_repetition": (
        f"WITH {_WORDS.format(extra=' concat_ws(chr(47), coalesce(project, chr(63)), coalesce(source, chr(63))) AS host,' + _STRIP.format(by='chr(10)') + ' AS ls,' + _STRIP.format(by='chr(10) || chr(10)') + ' AS ps,')},"
        f" d AS (SELECT doc_id, host, len(w) AS n_words, {_TWICE.format(x='ls')} AS line_share, {_TWICE.format(x='ps')} AS paragraph_share FROM t),"
        " m AS (SELECT d.*, coalesce(again, 0) AS triple_share, coalesce(rep, 0) AS n_repeated, coalesce(share, 0) AS repeated_share FROM d LEFT JOIN (SELECT doc_id, avg(again3::INT) AS again, sum(twice) AS rep, avg(twice) AS share FROM c GROUP BY 1) USING (doc_id)),"
        " r AS (SELECT *, list_filter([CASE WHEN line_share >= 0.3 - 1e-9 THEN 'line_share' END, CASE WHEN paragraph_share >= 0.3 - 1e-9 THEN 'paragraph_share' END, CASE WHEN triple_share >= 0.2 - 1e-9 THEN 'triple_share' END], lambda x: x IS NOT NULL) AS failed_rules FROM m),"
        " h AS (SELECT host, count(*) AS n, count(*) FILTER (len(failed_rules) > 0) AS k FROM r GROUP BY 1),"
        " z AS (SELECT sum(k) / sum(n) AS mean, greatest(sum(k * k / n) / sum(n) - (sum(k) / sum(n)) ** 2, 1e-9) AS var FROM h),"
        " v AS (SELECT host, (k + s * mean) / (n + s) AS host_rate, mean FROM h, (SELECT mean, greatest(mean * (1 - mean) / var - 1, 1) AS s FROM z))"
        " SELECT r.* REPLACE (array_to_string(failed_rules, ',') AS failed_rules), host_rate, mean > 0 AND host_rate >= 1.5 * mean - 1e-9 AS host_bad, len(failed_rules) > 0 OR (mean > 0 AND host_rate >= 1.5 * mean - 1e-9) AS checked FROM r JOIN v USING (host)"
    ),
}

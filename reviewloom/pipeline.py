"""Workbooks to the normalized table, in one plan for all files, and its command line.

    python -m reviewloom.pipeline preprocess IN OUT      column pairs for matching
    python -m reviewloom.pipeline process IN OUT MATCHES normalized table and report
    python -m reviewloom.pipeline full IN OUT MATCHES    both; stops where MATCHES is missing
    python -m reviewloom.pipeline describe PAIRS OUT     descriptions of the columns
    python -m reviewloom.pipeline match PAIRS OUT        match results, votes and candidates
    python -m reviewloom.pipeline qa NORMALIZED OUT      the questions, their answers and a log

Models, test modes and thresholds come from REVIEWLOOM_ variables (`config.py`).
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from reviewloom import rulesdata as D
from reviewloom.common import cut, ship
from reviewloom.config import JobConfig
from reviewloom.functions import rules as R
from reviewloom.operators import analytics as A
from reviewloom.operators import ingest as I
from reviewloom.operators import matching as M
from reviewloom.operators import models, qa
from reviewloom.operators import reshape as S
from reviewloom.sources import files, xlsx

REPEATED = tuple(D.REPEATED_WORDS)
TARGET_TEXT = {
    "comment_id": "Identifier of the comment", "section": "Part of the document the comment is about", "topic": "Subject of the comment", "round": "Number of the review round",
    "comment_type": "Kind of comment", "comment_text": "What the reviewer wrote", "response_text": "What the proponent answered", "author": "Who wrote the comment",
    "date_received": "Day the comment arrived", "date_responded": "Day the answer was sent", "status": "Where the comment stands", "agency": "Body the reviewer speaks for",
}


def column_pairs(read: DataFrame) -> DataFrame:
    """Each file's columns beside each target field, with samples and descriptions."""
    spark = read.sparkSession
    targets = spark.createDataFrame(list(TARGET_TEXT.items()), "target_column string, target_description string")
    s = M.samples(read, ["source_file", "source_column"], "cell_value").withColumn("source_description", R.description(F.col("source_column")))
    x = M.pair_table(s, targets)
    return x.select("source_column", "source_description", "sample_1", "sample_2", "sample_3", "target_column", "target_description", "source_file").distinct()


def mappings(matches: DataFrame, answer: str = "vote") -> DataFrame:
    """T3 on match results; `answer` is the vote or the best description's raw output."""
    m = matches
    if answer == "best_description":
        raw = F.coalesce(*[F.when(F.col("best_description_num") == i, F.col(f"raw_output_{i}")) for i in (1, 2, 3)])
        m = m.withColumn("confidence", R.first_answer(raw))
    elif "processed_output" in m.columns:
        m = m.withColumn("confidence", F.col("processed_output"))
    for c in ("sample_1", "sample_2", "sample_3"):
        if c not in m.columns:
            m = m.withColumn(c, F.lit(None).cast("string"))
    if "result_order" not in m.columns:
        m = m.withColumn("result_order", F.concat_ws("|", "source_file", "source_column", "target_column"))
    return M.resolve(m)


META = ("date_received", "date_responded", "status", "comment_type")


def normalize(read: DataFrame, mapping: DataFrame, wide_rules: bool = True, rounds: str = "positional") -> DataFrame:
    """One row per comment and response of all files, in the target schema.

    read: data cells with their column names. mapping: resolved pairs. Long and
    wide files go through one plan: a cell takes its column's target and, in wide
    files, round; cells are pivoted on the fixed targets only. Files without an
    identifier column get 1..n. `wide_rules=False` leaves the dates, statuses and
    types of wide files as they stand; `rounds="prefer_source"` takes a mapped
    round column before the position.
    """
    cols = read.select("source_file", "source_column", "col_idx").distinct()
    # Mappings are a few rows per file; they are written once and used several times.
    m = cut(mapping.select("source_file", "source_column", "target_column", "result_order").join(cols, ["source_file", "source_column"]))
    layout = S.structure(m).select("source_file", "data_structure")
    places = S.round_columns(m).select("source_file", "source_column", "target_column", F.col("round").alias("place"))
    mapped = m.join(layout, "source_file").join(places, ["source_file", "source_column", "target_column"], "left")
    wide, repeated = F.col("data_structure") == "wide", F.col("target_column").isin(*REPEATED)
    mapped = cut(mapped.withColumn("k", F.when(wide & repeated, F.col("place")).otherwise(1)).drop("col_idx", "place"))
    c = read.join(mapped, ["source_file", "source_column"])
    code = F.col("target_column").isin("agency", "status", "comment_type", "author")
    value = F.when(F.col("target_column") == "comment_id", R.numeric_id(F.col("cell_value"), F.col("vtype"))).when(~(code & (F.col("vtype") != "str")), F.col("cell_value")).otherwise("")
    # Several columns of one target and round: of texts the longest, leftmost; else the last mapped.
    is_text = F.col("target_column").isin("comment_text", "response_text")
    pick = F.struct(F.when(is_text, F.length(R.strip(F.col("text")))).otherwise(0), F.when(is_text, "").otherwise(F.col("result_order")), -F.col("col_idx"))
    c = c.withColumn("text", value).groupBy("source_file", "data_structure", "row_idx", "k", "target_column").agg(F.max_by("text", pick).alias("text"))
    p = c.groupBy("source_file", "data_structure", "row_idx", "k").pivot("target_column", list(D.TARGETS)).agg(F.first("text"))

    row = W.partitionBy("source_file", "row_idx")
    base = lambda v: F.max(F.when(F.col("k") == 1, v)).over(row)
    own = {t: S.own_value(F.col(t)) for t in META}
    p = p.withColumns({t: F.coalesce(v, base(v)) for t, v in own.items()} | {t: base(F.col(t)) for t in D.TARGETS if t not in REPEATED})
    p = p.where((F.col("data_structure") == "long") | S.has_text(F.col("comment_text")) | S.has_text(F.col("response_text")))
    has = m.groupBy("source_file").agg(*[F.max((F.col("target_column") == t).cast("int")).alias(f"has_{t}") for t in ("comment_id", "agency")])
    numbers = S.auto_id(read.select("source_file", "row_idx").distinct(), "source_file", "row_idx")
    p = p.join(has, "source_file").join(numbers, ["source_file", "row_idx"], "left")
    p = p.withColumn("comment_id", F.when(F.col("has_comment_id") == 1, F.col("comment_id")).otherwise(F.col("auto_id").cast("string")))
    p = S.long_rounds(p, "source_file", "comment_id", "row_idx")
    made = F.when(wide, F.col("k")).otherwise(F.col("round_no")).cast("string")
    p = p.withColumn("round", F.coalesce(F.nullif(R.round_number(F.col("round")), F.lit("")), made) if rounds == "prefer_source" else made)
    p = p.withColumn("agency", F.when(F.col("has_agency") == 1, R.agency_code(F.col("agency"))).otherwise(S.agency(F.lit(False), F.col("agency"), F.col("comment_id"), F.col("author"))))
    rules = {"date_received": R.standard_date, "date_responded": R.standard_date, "status": R.status, "comment_type": R.comment_type}
    p = p.withColumns({t: F.when(wide, F.col(t)).otherwise(f(F.col(t))) if not wide_rules else f(F.col(t)) for t, f in rules.items()})
    p = p.withColumns({"author": R.author(F.col("author")), "response_text": F.coalesce("response_text", F.lit("")), "project": R.project_name(F.col("source_file"))})
    return S.complete(p)


def report(rows: DataFrame) -> str:
    """K4: totals, coverage and the largest projects and agencies, aggregated on the cluster."""
    t = rows.agg(F.count("*").alias("n"), F.count_distinct("project").alias("p"), F.count_distinct(F.nullif("agency", F.lit(""))).alias("a")).first()
    full = rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in D.TARGETS})
    lines = [f"Rows: {t.n}", f"Projects: {t.p}", f"Agencies: {t.a}", "", "Coverage:"]
    lines += [f"  {r.column_name}: {r.percent:.1f}%" for r in A.coverage(full, D.TARGETS).collect()]  # a row per target
    for title, key in (("Projects", "project"), ("Agencies", "agency")):
        lines += ["", f"{title}:"] + [f"  {r[key]}: {r.n}" for r in A.top(full, key, 10).collect()]
    return "\n".join(lines) + "\n"


def candidates(d: DataFrame, embedder, k: int = 5, threshold: float = 0.25) -> DataFrame:
    """The pairs of the described table that pass the pre-filter by embeddings."""
    text = lambda i: models.embed(models.embed_text(F.col("source_column"), F.col(f"source_description_{i}")), embedder).alias(f"v{i}")
    src = M.first_by(d, ["source_column"], "source_file", "sample_1").select("source_column", text(1), text(2), text(3))
    tgt = d.select("target_column", "target_description").distinct().select("target_column", models.embed(models.embed_text(F.col("target_column"), F.col("target_description")), embedder).alias("v"))
    return M.expand(M.prefilter(src, tgt, k, threshold), d)


def described(pairs: DataFrame, describer=None, variants: int = 3) -> DataFrame:
    """The pair table with descriptions of columns and targets; models are asked once and their answers written."""
    return cut(models.describe(pairs.withColumn("pair_id", F.monotonically_increasing_id()), describer or models.name_describer, variants))


def match(pairs: DataFrame, embedder=None, judge=None, describer=None, k: int = 5, threshold: float = 0.25, settings: JobConfig | None = None, out: str | None = None) -> DataFrame:
    """Describe, pre-filter by embeddings, judge three times, vote, propagate.

    The models default to the offline stand-ins. F3: a target that is the
    project itself is no candidate. With `out`, the candidates, the filtered
    pair table, all results, the accepted ones and the votes are written there
    (K6, K7).
    """
    c = settings or JobConfig(top_k=k, threshold=threshold)
    embedder, judge, describer = embedder or models.hash_embedder, judge or models.keyword_judge, describer or models.name_describer
    d = described(c.test_rows(pairs.where("target_column is null or lower(target_column) <> 'project'")), describer, c.variants)
    kept = cut(candidates(d, embedder, c.top_k, c.threshold) if c.prefilter else d)
    judged = cut(models.judge(kept, judge, c.reasoned, c.with_samples))
    if out:
        if c.prefilter:
            files.write_candidates(kept.select("source_column", "target_column", "similarity_score", "best_description_num").distinct(), kept, out)
        files.write_matches(judged, out)
    return M.propagate(pairs, judged)


def preprocess(spark: SparkSession, folder: str, out: str) -> DataFrame:
    pairs = column_pairs(I.read(xlsx.cells(spark, folder).where("vtype <> 'error'")))
    files.write_csv(pairs, f"{out}/column_pairs")
    return pairs


def describe(spark: SparkSession, pairs: str, out: str, settings: JobConfig) -> DataFrame:
    """K5: the pair table with descriptions, and the descriptions of each column by themselves."""
    _, _, describer = models.plug_ins(settings.model, settings.server, settings.embedding, settings.reasoned)
    d = described(settings.test_rows(files.require(files.read_csv(spark, pairs, files.PAIRS), ["source_column", "target_column"])), describer, settings.variants)
    files.write_csv(d.drop("samples_key"), f"{out}/described")
    files.write_csv(M.first_by(d, ["source_column", "samples_key"], "pair_id").select("source_column", F.to_json("samples_key").alias("samples"), *[c for c in d.columns if c.startswith("source_description_")]), f"{out}/descriptions")
    return d


def match_files(spark: SparkSession, pairs: str, out: str, settings: JobConfig) -> DataFrame:
    """The pair table of `preprocess` to match results, under a folder named after the settings."""
    embedder, judge, describer = models.plug_ins(settings.model, settings.server, settings.embedding, settings.reasoned)
    p = files.require(files.read_csv(spark, pairs, files.PAIRS), ["source_column", "target_column", "source_file", *files.sample_columns(files.read_csv(spark, pairs, files.PAIRS))])
    got = match(p, embedder, judge, describer, settings=settings, out=f"{out}/{settings.run_name()}")
    files.write_csv(got, f"{out}/{settings.run_name()}/matches")
    return got


def questions(spark: SparkSession, rows: str, out: str, settings: JobConfig) -> int:
    """The fifteen questions put to the routed queries, or to a model on a server; exit code 0 if all answers match."""
    t = spark.read.parquet(rows)
    r = cut(A.review(t if "rec_id" in t.columns else t.withColumn("rec_id", F.monotonically_increasing_id())))
    ask = (lambda q: qa.answer(r, q)) if settings.model == "offline" else qa.server_asker(r, settings.server, settings.model)
    return qa.write_results(qa.evaluate(r, ask), out)


def process(spark: SparkSession, folder: str, out: str, matches: str) -> DataFrame:
    rows = normalize(I.read(xlsx.cells(spark, folder).where("vtype <> 'error'")), mappings(files.read_csv(spark, matches)))
    rows.write.mode("overwrite").parquet(f"{out}/normalized")
    rows = spark.read.parquet(f"{out}/normalized")
    files.write_csv(rows, f"{out}/combined")
    files.write_csv(rows, f"{out}/individual", by="source_file")
    spark.createDataFrame([(report(rows),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/summary")
    return rows


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("mode", choices=("preprocess", "process", "full", "describe", "match", "qa"))
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("matches", nargs="?")
    a = p.parse_args(args)
    settings = JobConfig.of()
    spark = SparkSession.builder.appName("reviewloom").getOrCreate()
    ship(spark)
    if a.mode == "describe":
        describe(spark, a.input, a.output, settings)
    if a.mode == "match":
        match_files(spark, a.input, a.output, settings)
    if a.mode == "qa":
        return questions(spark, a.input, a.output, settings)
    if a.mode in ("preprocess", "full"):
        preprocess(spark, a.input, a.output)
    if a.mode in ("process", "full"):
        try:
            if not a.matches:
                raise ValueError("none named")
            files.read_csv(spark, a.matches)
        except (AnalysisException, ValueError):
            print("match results are missing")
            return 1
        process(spark, a.input, a.output, a.matches)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

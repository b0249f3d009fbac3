from pyspark.sql import functions as F

from reviewloom.common import is_empty, table
from reviewloom.operators import profile as P

COLS = "rec_id bigint, load_no int, round string, date_received string, status string, source_file string, finding string, n bigint"


def rows(spark, data):
    return spark.createDataFrame(data, COLS)


def test_cells_and_clashing_names(spark):
    x = rows(spark, [
        (1, 1, "1", "2020-02-30", "Open", "a_202001.xlsx", "z", 9), (2, 1, "13", "1999-12-31", "op3n", "A_202001.xlsx", "z", 9),
        (3, 1, "1.0", "2020-02-29", "#", "x", None, None), (4, 1, None, "", " ", "~", None, None), (4, 1, None, "", " ", "~", None, None), (5, None, "1\n", "2020-1-1", "é", "_202001.xlsx", None, None),
    ])
    got = {(r.finding, r.column_name, r.case_key) for r in P.cell_findings(x).collect()}
    assert got == {
        ("pattern", "date_received", 1), ("range", "round", 2), ("range", "date_received", 2), ("pattern", "status", 2), ("pattern", "source_file", 2),
        ("pattern", "round", 3), ("pattern", "status", 3), ("pattern", "round", 5), ("pattern", "date_received", 5), ("pattern", "source_file", 5),
    }


def test_loads(spark):
    data = [(i, k, str(1 + i % 4), f"2020-01-{1 + i % 28:02d}", "Open" if i % 2 else "Closed", "a_202001.xlsx", None, None) for k in range(1, 6) for i in range(40)]
    data += [(i, 6, "9", "2020-01-01", None if i < 20 else "Open", "a_202001.xlsx", None, None) for i in range(40)]
    got = {(r.finding, r.column_name, r.case_key) for r in P.load_findings(P.states(rows(spark, data))).collect()}
    assert got == {("distribution", "round", 6), ("distribution", "status", 6), ("constant", "date_received", 6), ("null_rate", "status", 6)}


def test_states_merge(spark, sf):
    n = table(spark, sf, "normalized_output_example")
    whole = P.states(n)
    parts = P.merge(P.states(n.where("rec_id % 3 = 0")), P.states(n.where("rec_id % 3 = 1")), P.states(n.where("rec_id % 3 = 2")))
    assert whole.exceptAll(parts.select(whole.columns)).isEmpty() and parts.select(whole.columns).exceptAll(whole).isEmpty()


def test_a_new_load_is_scanned_alone(spark, tmp_path):
    """A second load is added; the scan of the first is not repeated, a late row comes in on request."""
    data = [(i, k, str(1 + i % 4), "2020-01-01", "Open", "a_202001.xlsx", None, None) for k in (1, None) for i in range(10)]
    store = P.Store(spark, (tmp_path / "states").as_uri())
    store.refresh(rows(spark, data))
    new = rows(spark, [(99, 1, "7", None, None, None, None, None)] + [(i, 2, "5", None, "Open", None, None, None) for i in range(3)])
    assert {r.load_no for r in store.unseen(new).collect()} == {2}
    again = P.Store(spark, store.path)
    prof = {(r.load_no, r.column_name): r for r in P.profile(again.refresh(new).states()).collect()}
    assert len(prof) == 12 and prof[1, "round"].n_rows == prof[None, "round"].n_rows == 10 and prof[2, "round"].n_rows == 3
    assert P.profile(again.refresh(new.where("load_no = 1"), again=(1,)).states()).where("load_no = 1 and column_name = 'round'").first().n_rows == 1
    assert again.unseen(new.where("load_no = 1")).isEmpty()
    # The condition on loads reaches the files.
    new.write.parquet((tmp_path / "t").as_uri())
    plan = again.unseen(spark.read.parquet((tmp_path / "t").as_uri()))._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "load_no" in plan.split("PushedFilters")[1][:200]


def test_history(spark):
    m = spark.createDataFrame([("c", k, "empty_share", v) for k, v in enumerate((0.1, 0.11, 0.1, 0.12, 0.6, 0.1))], "column_name string, load_no int, metric string, value double")
    assert {r.load_no: r.signal for r in P.history(m).collect()} == {3: False, 4: True, 5: False}


def test_sketches(spark, sf):
    """Estimates against the exact figures; parts merge to the whole; odd columns give defined results."""
    n = table(spark, sf, "normalized_output_example").withColumn("nothing", F.lit(None).cast("string"))
    cols = ["rec_id", "comment_text", "agency", "nothing"]
    whole = {r.column_name: r for r in P.sketch_profile(P.merge_sketches(P.sketch_states(n, cols), by=("column_name",))).collect()}
    parts = P.merge_sketches(*[P.sketch_states(n.where(f"rec_id % 3 = {i}"), cols) for i in range(3)], by=("column_name",))
    assert {r.column_name: (r.n_rows, r.n_empty, r.min_value, r.max_value) for r in parts.collect()} == {c: (r.n_rows, r.n_empty, r.min_value, r.max_value) for c, r in whole.items()}
    for c in cols[:3]:
        v = [x for x in n.select(F.col(c).cast("string").alias("v")).where(~is_empty(F.col("v"))).toPandas().v]
        assert whole[c].n_rows - whole[c].n_empty == len(v) and abs(whole[c].n_distinct - len(set(v))) <= 0.05 * len(set(v)) + 1
        size = sorted(map(len, v))
        assert size[int(len(v) * 0.45)] <= whole[c].median_length <= size[int(len(v) * 0.55)]
    assert abs(whole["agency"].top_share - n.where(F.col("agency") == whole["agency"].top_value).count() / (whole["agency"].n_rows - whole["agency"].n_empty)) < 0.01
    assert (whole["nothing"].n_empty, whole["nothing"].n_distinct, whole["nothing"].top_value, whole["nothing"].median_length) == (n.count(), 0, None, None)
    assert P.sketch_profile(P.sketch_states(n.limit(0), cols)).count() == 0


def test_empty(spark):
    e = rows(spark, [])
    assert P.findings(e).count() == 0 and P.profile(P.states(e)).count() == 0

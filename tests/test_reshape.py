import itertools

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.operators import matching as M
from reviewloom.operators import reshape as S


def test_vote_is_symmetric(spark):
    rows = list(itertools.product(["Yes", "No", "Unknown"], repeat=3))
    df = spark.createDataFrame(rows, "output_1 string, output_2 string, output_3 string")
    got = {(r.output_1, r.output_2, r.output_3): (r.processed_output, r.unanimous, r.agreement_level) for r in M.voted(df).collect()}
    for k, v in got.items():
        top = max(set(k), key=k.count)
        want = top if k.count(top) > 1 else "Yes"
        assert v == (want, len(set(k)) == 1, k.count(want)) and all(got[p][0] == v[0] for p in itertools.permutations(k))


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(1, 5))), max_size=25))
def test_mixed_rounds(spark, rows):
    df = spark.createDataFrame([(i, k, x) for i, (k, x) in enumerate(rows)], "i int, k string, x int")
    got = [r.round_no for r in S.mixed_round(df, ["k"], "x", "i").orderBy("i").collect()]
    want, seen = [], {}
    for k, x in rows:
        most = max((y for q, y in rows if q == k and y is not None), default=0)
        if x is None:
            seen[k] = seen.get(k, 0) + 1
        want.append(None if k is None else x if x is not None else most + seen[k])
    assert got == want


def test_wide_to_long(spark):
    df = spark.createDataFrame([(1, " c1 ", None, "-", "2020-01-01", None, "r2"), (2, " ", "", "x", None, None, None)], "id int, comment_text_1 string, response_text_1 string, status_2 string, date_received_1 string, comment_text_2 string, response_text_2 string")
    got = [(r.id, r.round, r.comment_text, r.response_text, r.date_received) for r in S.wide_to_long(df, ["id"], 2).orderBy("id", "round").collect()]
    assert got == [(1, 1, "c1", "", "2020-01-01"), (1, 2, None, "r2", "2020-01-01")]


def test_longest_first_wins(spark):
    df = spark.createDataFrame([("ab", "cd", None), (" ", None, ""), ("a", "bcd ", "xy")], "a string, b string, c string")
    assert [r.v for r in df.select(S.longest(["a", "b", "c"]).alias("v")).collect()] == ["ab", "", "bcd"]


def test_auto_id_over_slices(spark):
    df = spark.range(0, 250, 1, 5).withColumn("f", (F.col("id") % 3).cast("string"))
    for r in S.auto_id(df, "f", "id", 10).groupBy("f").agg(F.sort_array(F.collect_list("auto_id")).alias("a"), F.count("*").alias("n")).collect():
        assert r.a == list(range(1, r.n + 1))


def test_schema_and_union(spark):
    a, b = spark.createDataFrame([("x",)], "agency string"), spark.createDataFrame([("y",)], "author string")
    assert S.complete(S.union_by_name(a, b)).columns[:2] == ["comment_id", "section"]

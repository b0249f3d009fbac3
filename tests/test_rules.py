"""Golden values of the scalar rules."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.functions import rules as R


def run(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.o for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


CASES = [
    (R.agency_from_id, {"EMLI-001": "EMLI", "123": "", "AGY_R1.01": "AGY", "AGY 001": "AGY", "AGY001": "AGY", "ABC.DEFG-002": "ABC", "agy-1": "", None: "", "": ""}),
    (R.agency_code, {"EMLI Geotechnical": "EMLI", "Transport Canada": "TC", "Ministry": "Ministry", "X": "X", None: "", "Upper River Nation": "URN", "WXYZ": "WXYZ"}),
    (R.agency_from_author, {"Jane Doe, EMLI - Geoscience": "EMLI", "Jane Doe": "", None: ""}),
    (R.standard_date, {
        "2022-1-5": "2022-01-05", "03/04/2022": "2022-03-04", "13/04/2022": "2022-04-13", "20220105": "2022-01-05", "2022-01-15 00:00:00": "2022-01-15",
        "TBD": "TBD", "5-6-22": "2022-05-06", "April 30 2015": "2015-04-30", "2022-02-30": "2022-02-30", None: "",
    }),
    (R.status, {"Pending": "Open", "inactive": "Open", "incomplete": "Closed", "Withdrawn": "Withdrawn", " open ": "Open", None: ""}),
    (R.comment_type, {"IR": "Information Requirement", "technical comments": "General Comment", None: ""}),
    (R.round_number, {"Round 2": "2", "R2": "2", "Phase 3": "3", "none": "none", None: ""}),
    (R.author, {"Dr.  Jane   Doe": "Jane Doe", "Dr. Mr. X": "Mr. X", None: ""}),
    (R.base_id, {"ABC-123-R1": "ABC-123", "AGY_R1.01": "AGY.01", "ABR1": "ABR1", "A_R1B_R1": "AB_R1", None: None}),
    (R.id_round, {"ABC-123-R1": 1, "AGY_R1.01": 1, "ABR1": None, "X Round 3": 3}),
    (R.column_name, {"Date_Received: ": "date received", None: ""}),
    (R.first_answer, {"Yes.": "Yes", "know": "No", "maybe": "", None: ""}),
    (R.any_answer, {"I know": "No", "": "Unknown", "yes": "Yes"}),
    (R.last_line_answer, {"Yes?\nNo\n": "No", "No\nYes": "Yes", None: "Unknown"}),
    (R.project_name, {"/a/b/x.xlsx": "x"}),
]


@pytest.mark.parametrize("f,cases", CASES, ids=lambda x: getattr(x, "__name__", ""))
def test_golden(spark, f, cases):
    assert run(spark, f, list(cases)) == list(cases.values())


def test_answers(spark):
    df = spark.createDataFrame([("1,234.0", "1234"), ("The answer is EMLI.", "EMLI"), ("a 5", "b 6"), (None, None), ("x", None)], "a string, b string")
    assert [r.m for r in df.select(R.answers_match(F.col("a"), F.col("b")).alias("m")).collect()] == [True, True, False, True, False]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.dates(min_value=__import__("datetime").date(1970, 1, 1), max_value=__import__("datetime").date(2068, 12, 31)), min_size=1, max_size=20))
def test_dates_are_idempotent(spark, days):
    once = run(spark, R.standard_date, [d.isoformat() for d in days])
    assert once == [d.isoformat() for d in days] == run(spark, R.standard_date, once)

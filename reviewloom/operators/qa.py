"""Questions in words, answered by the registered queries; and the check of anybody's answers.

No generated code is run: a question goes to the registered query whose wording
it is closest to, or to a plug-in that returns text.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.functions import rules as R
from reviewloom.operators.analytics import QUESTIONS
from reviewloom.operators.models import http_generator
from reviewloom.sources.files import write_csv

WORDING = {
    "g01_round1_count": "How many comments are in round 1?",
    "g02_most_common_agency": "Which agency is the most common?",
    "g03_round_with_most_rows": "Which round has the most comments?",
    "g04_most_common_agency_rows": "How many comments has the most common agency?",
    "g05_unanswered_count": "How many comments are unanswered?",
    "g06_median_days_round2": "What is the median response time of round 2 in days?",
    "g07_agency_lowest_median": "Which agency has the lowest median response time?",
    "g08_share_within_30_round2": "What percentage of round 2 answers came within 30 days?",
    "g09_round1_top_agency": "Which agency has the most comments in round 1?",
    "g10_agency_highest_unanswered": "Which agency has the highest rate of unanswered comments?",
    "g11_agency_highest_p90": "Which agency has the highest 90th percentile of response time?",
    "g12_unanswered_last_90_days": "How many comments of the last 90 days are unanswered?",
    "g13_project_highest_median": "Which project has the highest median response time?",
    "g14_agency_largest_increase": "Which agency has the largest increase of mean response time from round 1 to round 3 and later?",
    "g15_top_pair_share": "Which project and agency pair has the largest share of its project?",
}


def route(question: str) -> str:
    """The registered query nearest to a question by shared words (Jaccard), the first of equals."""
    words = lambda s: set(re.findall(r"[a-z0-9]+", s.lower()))
    q = words(question)
    return max(WORDING, key=lambda k: (len(q & words(WORDING[k])) / max(1, len(q | words(WORDING[k]))), -list(WORDING).index(k)))


def answer(review: DataFrame, question: str) -> str:
    """The registered query's answer as text; '' where there is none."""
    row = QUESTIONS[route(question)](review).first()
    return "" if row is None or row[0] is None else str(row[0])


def server_asker(review: DataFrame, url: str, model: str, context: str = "", tokens: int = 1000, timeout: float = 300, retries: int = 3) -> Callable[[str], str]:
    """A model on a generation server, told the columns of the table and, before each question, the context.

    The model answers in words from what it is told; no code that it writes is run.
    """
    ask = http_generator(url, model, tokens=tokens, stop=(), timeout=timeout, retries=retries)()
    told = context or "A table of review comments has these columns: " + ", ".join(f"{c} ({t})" for c, t in review.dtypes) + "."

    def answer_one(question: str) -> str:
        text = ask([f"{told}\n\n{question}"])[0]
        if not text:
            raise ConnectionError("the model gave no answer")
        return text

    return answer_one


def write_results(results: DataFrame, folder: str) -> int:
    """K8: the results as CSV and a log of them as text, in `folder`; gives the exit code."""
    rows = results.orderBy("test_number")
    write_csv(rows.coalesce(1), f"{folder}/results")
    line = F.format_string("%d. %s | given: %s | actual: %s | %s | %.2f s", "test_number", "question", "given_answer", "actual_answer", F.when(F.col("match"), "match").otherwise("no match"), "response_time_seconds")
    total = results.agg(F.format_string("%d of %d match", F.count_if("match"), F.count("*")).alias("value"))
    rows.select(line.alias("value")).coalesce(1).unionByName(total).coalesce(1).write.mode("overwrite").text(f"{folder}/log")
    return passed(results)


def evaluate(review: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """Each question put to `ask` and held against the registered answer; one row per question.

    An exception of `ask` counts as the answer 'error: ...'.
    """
    out = []
    for i, (name, text) in enumerate(WORDING.items(), 1):
        began = time.time()
        try:
            given = ask(text)
        except Exception as e:  # noqa: BLE001 - whatever a plug-in raises is its answer
            given = f"error: {e}"
        took = time.time() - began
        row = QUESTIONS[name](review).first()
        out.append((i, text, given, "" if row is None or row[0] is None else str(row[0]), took))
    df = review.sparkSession.createDataFrame(out, "test_number int, question string, given_answer string, actual_answer string, response_time_seconds double")
    return df.withColumn("match", R.answers_match(F.col("given_answer"), F.col("actual_answer")))


def passed(results: DataFrame) -> int:
    """Exit code: 0 if every answer matched."""
    return 0 if results.where("not match").isEmpty() else 1

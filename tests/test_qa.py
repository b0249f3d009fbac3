import pytest

from reviewloom.common import table
from reviewloom.config import JobConfig
from reviewloom.operators import analytics as A
from reviewloom.operators import qa


def test_every_wording_routes_to_its_query():
    assert set(qa.WORDING) == set(A.QUESTIONS) and all(qa.route(t) == k for k, t in qa.WORDING.items())


def test_evaluation(spark, sf):
    r = A.review(table(spark, sf, "normalized_output_example")).cache()
    good = qa.evaluate(r, lambda q: f"The answer is {qa.answer(r, q)}.")
    assert good.count() == len(qa.WORDING) and qa.passed(good) == 0
    bad = qa.evaluate(r, lambda q: 1 / 0)
    assert qa.passed(bad) == 1
    r.unpersist()


def test_empty_table(spark, sf):
    e = A.review(table(spark, sf, "normalized_output_example").limit(0))
    assert qa.answer(e, "How many comments are in round 1?") == "0" and qa.answer(e, "Which agency is the most common?") == ""


def test_config():
    c = JobConfig.of({"REVIEWLOOM_TOP_K": "3", "REVIEWLOOM_REASONED": "true", "OTHER": "x"})
    assert (c.top_k, c.reasoned, c.run_name()) == (3, True, "offline_reasoned_samples_top3")
    with pytest.raises(ValueError):
        JobConfig(top_k=0)

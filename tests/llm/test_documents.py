"""Repetition, packing and mixing against plain versions."""

import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from reviewloom.common import table
from reviewloom.llm import mixing, packing, repetition as R
from reviewloom.llm.tokens import DEFAULT_VOCABULARY, count_tokens, encoder, token_count

D = "doc_id bigint, text string, project string, source string, n int, h string"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=40), st.integers(1, 6))
def test_mask(words, run):
    seen, want = {}, [False] * len(words)
    for i in range(len(words) - run + 1):
        k = tuple(words[i : i + run])
        if k in seen:
            want[i : i + run] = [True] * run
        seen.setdefault(k, i)
    assert R.repeated_mask(words, run).tolist() == want


def test_words():
    assert R.words_of("The 12.73 mg/L, THE 4 mg/l_x; don’t") == ["the", "0", "mg", "l", "the", "0", "mg", "l", "x", "don’t"]


def test_found(spark):
    a = "one two three four five six seven eight nine ten. "
    docs = [(1, a + a.upper(), "p", "s", 1, "z"), (2, a, "p", "s", 1, "z"), (3, None, None, None, None, None), (4, "", "p", None, 1, "z"), (5, a * 20_000, None, "s", 1, "z"), (5, a * 2, "p", "s", 1, "z"), (None, a + a, "p", "s", 1, "z")]
    got = R.found(spark.createDataFrame(docs, D))
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 5, 5]
    assert R.found(spark.createDataFrame([], D)).count() == 0


def _exact_cases(docs):
    return {r.doc_id for r in docs.collect() if r.text and (w := R.words_of(r.text)) and R.exact(r.text) / len(w) >= R.SHARE}


def test_found_is_what_checking_all_finds(spark, sf):
    docs = table(spark, sf, "documents")
    assert {r.doc_id for r in R.found(docs).collect()} == _exact_cases(docs) != set()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60))
def test_no_case_passes_the_rules(words):
    """The limit on triples is the least that a case can have."""
    if words and R.repeated_mask(words).mean() >= R.SHARE:
        assert R.triple_share(words) >= R.RULES["triple_share"] - 1e-9


def test_host_verdicts_choose_what_is_checked(spark):
    """Every document of a host that fails often is checked; elsewhere only failures are."""
    bad, good = "one two three four five six seven eight. " * 3, "each of these words stands here but once"
    docs = [(i, bad if i % 2 else good, "p", "bad", 1, "z") for i in range(40)] + [(100 + i, bad if i == 7 else good, "p", "good", 1, "z") for i in range(200)]
    df = spark.createDataFrame(docs, D)
    assert {r.host for r in R.hosts(R.measures(df)).where("host_bad").collect()} == {"p/bad"}
    ids = sorted(r.doc_id for r in R.checked(df).collect())
    assert ids == [*range(40), 107]
    # Without the host level the twenty others of that host would not be checked.
    assert sorted(r.doc_id for r in R.measures(df).where("size(failed_rules) > 0").collect()) == [*range(1, 40, 2), 107]
    assert sorted(r.doc_id for r in R.judged(df).where("checked").collect()) == ids


def test_host_rates_are_shrunk(spark, sf):
    j = R.judged(table(spark, sf, "documents")).groupBy("host").agg(F.count("*").alias("n"), F.avg((F.size("failed_rules") > 0).cast("double")).alias("p"), F.first("host_rate").alias("r")).collect()
    mean = sum(x.n * x.p for x in j) / sum(x.n for x in j)
    assert all(min(x.p, mean) - 1e-9 <= x.r <= max(x.p, mean) + 1e-9 for x in j)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 35), max_size=60), st.integers(1, 20), st.integers(1, 4))
def test_best_fit(sizes, capacity, n_open):
    boxes = {}
    for size, pieces in zip(sizes, packing.best_fit(sizes, capacity, n_open)):
        assert sum(n for _, _, n in pieces) == size and (len(pieces) == 1 or size > capacity) and len(pieces) <= size // capacity + 1
        assert [a for _, a, _ in pieces] == [sum(n for _, _, n in pieces[:i]) for i in range(len(pieces))]
        for b, _, n in pieces:
            boxes[b] = boxes.get(b, 0) + n
    assert all(v <= capacity for v in boxes.values()) and set(boxes) == set(range(len(boxes)))


def test_best_fit_takes_the_tightest():
    assert packing.best_fit([6, 8, 2, 4], 10) == [[(0, 0, 6)], [(1, 0, 8)], [(1, 0, 2)], [(0, 0, 4)]]
    # With one place the fuller one is closed.
    assert packing.best_fit([6, 8, 2, 4], 10, 1) == [[(0, 0, 6)], [(1, 0, 8)], [(1, 0, 2)], [(2, 0, 4)]]


def test_pack(spark, sf):
    docs, specs = table(spark, sf, "documents"), table(spark, sf, "container_specs")
    p = packing.pack(docs, specs, group=40).toPandas()
    sizes = {r.doc_id: r.n for r in docs.select("doc_id", token_count(F.col("text")).alias("n")).collect()}
    for (spec, cap), g in p.groupby(["spec_name", "capacity_tokens"]):
        assert g.groupby("doc_id").n_tokens.sum().to_dict() == sizes and g.groupby("container_id").n_tokens.sum().max() <= cap
        assert (g.groupby("doc_id").size() == 1).sum() >= sum(n <= cap for n in sizes.values())
    assert (packing.usage(packing.pack(docs, specs)).toPandas().unused_share < 0.2).all()


def test_pack_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b", None, None, 5, "z"), (1, "a b", None, None, 5, "z"), (None, None, None, None, None, None), (2**60 + 1, "", None, None, None, None)], D)
    specs = spark.createDataFrame([("s", 1, 0), ("bad", 0, 0), (None, None, 0)], "spec_name string, capacity_tokens int, g int")
    got = packing.pack(docs, specs).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 1), (1, 1), (1, 1), (1, 1), (2**60 + 1, 0)]
    assert packing.pack(docs.limit(0), specs).count() == 0 and packing.pack(docs, specs.limit(0)).count() == 0


def test_pfair_is_within_one_block():
    w = {"a": 0.45, "b": 0.3, "c": 0.2, "d": 0.05}
    plan = mixing.pfair(w, 2000)
    given_ = dict.fromkeys(w, 0)
    for t, (s, j, release, deadline) in enumerate(plan, 1):
        assert j == given_[s] and release <= t - 1 < deadline
        given_[s] += 1
        assert all(abs(given_[x] - w[x] * t) < 1 for x in w)


def test_mix(spark, sf):
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mixture_targets")
    m = mixing.mix(docs, targets, period=64, bucket=20)
    p = m.toPandas().sort_values(["slot", "token_offset"])
    most = {r.source: r.max_repeats for r in targets.collect()}
    assert all(g.use_no.max() < most[s] for s, g in p.groupby("source")) and not p.duplicated(["doc_id", "use_no"]).any()
    # A source's line: no gap, no overlap, its passes alike.
    for _, g in p.groupby("source"):
        g = g.sort_values("token_offset")
        assert (g.token_offset.values[1:] == (g.token_offset + g.n_tokens).values[:-1]).all() and g.token_offset.iloc[0] == 0
    s = mixing.shares(m, targets.withColumn("tokens", F.lit(1))).toPandas()
    assert (s.most_uses <= s.max_repeats).all()
    # Half a document and a block of each source.
    total = p.n_tokens.sum()
    big = {r.source: r.n for r in docs.groupBy("source").agg(F.max(token_count(F.col("text"))).alias("n")).collect() if r.source}
    spare = sum(n / 2 + total / 32 for n in big.values())
    assert all(abs(r.tokens - r.target_share * total) <= big[r.source] / 2 + total / 32 + r.target_share * spare for r in s.itertuples())


def test_blocks_do_not_grow_with_the_data():
    """Ten times the tokens: the same blocks in ten times the slots, each source less than one block from its share at every slot."""
    take = {"a": 43_000_000, "b": 21_000_000, "c": 700_000, "d": 9_000}
    small, large = mixing.period_of(take), mixing.period_of({s: 10 * n for s, n in take.items()})
    assert small[0] == large[0] == mixing.pfair({s: h for s, (h, _) in small[1].items()}, len(small[0]))
    for s, (h, size) in large[1].items():
        assert size <= mixing.BLOCK and h == small[1][s][0] and abs(size - small[1][s][1]) <= 0.05 * size + 1
    whole, got = len(large[0]), dict.fromkeys(take, 0)
    for t, (s, *_) in enumerate(large[0] * 3, 1):
        got[s] += 1
        assert all(abs(got[x] - large[1][x][0] * t / whole) < 1 for x in take)


def test_slots_follow_the_period(spark, sf):
    """Blocks stand where the repeated period has them, for several periods."""
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mixture_targets")
    p = mixing.mix(docs, targets, block=50, period=32).toPandas()
    place = p.drop_duplicates(["source", "block"]).sort_values("slot")
    assert p.groupby(["source", "block"]).slot.nunique().max() == 1 and place.slot.is_unique and p.slot.max() > 200
    assert (place.release <= place.slot).all() and (place.slot < place.deadline).all()
    for _, g in place.groupby("source"):
        assert g.block.is_monotonic_increasing


def test_mix_short_sources(spark, sf):
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mixture_targets")
    p = mixing.mix(docs, targets, total_tokens=10**7, period=64).toPandas()
    n = {r.source: r.n for r in docs.where("text <> ''").groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert {s: len(g) for s, g in p.groupby("source")} == {r.source: n[r.source] * r.max_repeats for r in targets.collect() if r.source in n}


def test_mix_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", None, "s", 5, "z"), (1, "a b c", None, "s", 5, "z"), (None, None, None, "s", None, None), (2, "", None, "s", None, None), (3, "x", None, None, 1, "z"), (4, "x", None, "t", 1, "z")], D)
    targets = spark.createDataFrame([("s", 1.0, 1, 7), (None, 0.5, 1, 7), ("u", 0.0, 1, 7)], "source string, target_share double, max_repeats int, tokens int")
    assert sorted(r.doc_id for r in mixing.mix(docs, targets).collect()) == [1, 1]
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0
    assert mixing.shares(mixing.mix(docs.limit(0), targets), targets).count() == 3


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.sampled_from("abcd"), st.tuples(st.integers(1, 10**6), st.integers(1, 99), st.integers(1, 4)), min_size=1))
def test_balanced(x):
    sizes, goal = {s: v[0] for s, v in x.items()}, {s: (v[1] / 100, v[2]) for s, v in x.items()}
    take = mixing.balanced(sizes, goal)
    total, whole = sum(take.values()), sum(w for w, _ in goal.values())
    for s, n in take.items():
        assert sizes[s] <= n <= sizes[s] * goal[s][1]
        # Off its share only where a bound holds it.
        gap = n - goal[s][0] / whole * total
        assert abs(gap) <= 2 * len(x) or (n == sizes[s] if gap > 0 else n == sizes[s] * goal[s][1])


def test_mix_uses_every_document(spark, sf):
    docs, targets = table(spark, sf, "documents"), table(spark, sf, "mixture_targets")
    named = [r.source for r in targets.collect()]
    few = spark.createDataFrame([(10**9, "a b c", None, "elder_interview", 5, "z")], D).select("doc_id", "source", "text")
    skewed = docs.where("coalesce(source, '') <> 'elder_interview'").select("doc_id", "source", "text").unionByName(few)
    for d in (docs, skewed):
        sized = mixing.usable(d, targets)
        m = mixing.mix(d, targets, sized=sized)
        want = {r.doc_id for r in d.where(F.col("source").isin(*named) & (F.col("text") != "")).collect()}
        assert {r.doc_id for r in m.collect()} == want
        s = mixing.shares(m, targets, sized).toPandas()
        assert (s.unused_tokens == 0).all() and (s.usable_tokens > 0).all() and (s.most_uses <= s.max_repeats).all()
    exact = mixing.shares(mixing.mix(skewed, targets, exact_shares=True), targets, mixing.usable(skewed, targets)).toPandas()
    assert exact.unused_tokens.sum() > 0


@pytest.mark.parametrize("text,n", [(None, 0), ("", 0), ("hello world", 2)])
def test_tokens(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(token_count(F.col("t"))).first()[0] == n


@settings(max_examples=200, deadline=None)
@given(st.text(" \n\ta.1\u00a0", max_size=60), st.integers(2, 6))
def test_long_runs_change_nothing(text, long_run):
    assert count_tokens(text, long_run=long_run) == len(encoder(DEFAULT_VOCABULARY).encode_ordinary(text))


def test_endless_blanks():
    n = 1_200_000
    assert count_tokens("a" + " " * n + "b") == count_tokens("a" + " " * (n // 2) + "b") + n // 2 and count_tokens("\n" * n) > 0


def test_queries_run(spark, sf):
    from reviewloom.llm import queries

    for name, f in queries.QUERIES.items():
        df = f(spark, sf)
        assert len(df.columns) == len(set(df.columns)) and df.count() > 0, name

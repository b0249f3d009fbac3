"""Variant spellings and the canonical list."""

import random

import pytest
from hypothesis import given, settings, strategies as st

from reviewloom.llm import canonical as C
from reviewloom.llm import names as N
from reviewloom.llm import variants as V

CAN = "field_name string, item_id int, canonical_value string, short_code string, also_known string, price string"
LIST = [
    ("agency", 1, "Ministry of Forest Lands", "MFL", "Forest Lands Ministry; ", "z"), ("agency", 2, "Upper Sallow Tribal Council", "USTC", None, None), ("agency", 3, "Lower Sallow Tribal Council", "LSTC", "", None),
    ("status", 4, "Open", None, "Pending", None), ("status", 5, "Closed", None, None, None), ("status", 6, "In Progress", None, None, None), ("agency", 1, "Ministry of Forest Lands", "MFL", None, None), (None, 9, None, None, None, None),
]


@settings(max_examples=200, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7), st.integers(0, 4))
def test_edits(a, b, most):
    """Against the plain recursion of the unrestricted distance."""
    def slow(a, b):
        d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                v = [d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1]
                v += [d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1) for k in range(1, i) for m in range(1, j) if a[k - 1] == b[j - 1] and a[i - 1] == b[m - 1]]
                d[i, j] = min(v)
        return d[len(a), len(b)]

    assert N.edits(a, b, most) == min(slow(a, b), most + 1)


def clusters(linked):
    out = {}
    for r in linked.collect():
        out.setdefault((r.field_name, r.name_scope, r.entity), set()).add(r.value)
    return sorted((f, s, tuple(sorted(v))) for (f, s, _), v in out.items())


def test_variants(spark):
    rows = [("agency", "all", "org", v, n) for v, n in {
        "Ministry of Forest Lands": 9, "ministry pf forest lands": 2, "M.F.L.": 3, "Forest Lands, Ministry of": 1, "MFL - Lands": 1, "Forest Lands Ministri": 50,
        "Upper Sallow Tribal Council": 5, "Lower Sallow Tribal Council": 5, "USTC": 8, "Bird Club": 4, "Bird  Club": 1, "various": 3, "?!": 1,
    }.items()]
    rows += [("author", p, "person", v, n) for p in ("p", "q") for v, n in {"Kwame Thirlamark": 9, "Thirlamark, K.": 1, "Ingrid Thirlamarn": 8, "Inge Thirlamarn": 1, "KThirlamark": 2, "Dr. Ingrid Thirlamarn": 2}.items()]
    df = spark.createDataFrame(rows, "field_name string, name_scope string, kind string, value string, n bigint")
    got = clusters(V.link(df, V.known_agencies(spark.createDataFrame(LIST, CAN))))
    assert got == sorted([
        ("agency", "all", tuple(sorted(["Ministry of Forest Lands", "ministry pf forest lands", "M.F.L.", "Forest Lands, Ministry of", "MFL - Lands", "Forest Lands Ministri"]))),
        ("agency", "all", ("USTC", "Upper Sallow Tribal Council")), ("agency", "all", ("Lower Sallow Tribal Council",)), ("agency", "all", ("Bird  Club", "Bird Club")), ("agency", "all", ("?!",)), ("agency", "all", ("various",)),
        *[("author", p, tuple(sorted(x))) for p in ("p", "q") for x in (["Kwame Thirlamark", "Thirlamark, K.", "KThirlamark"], ["Ingrid Thirlamarn", "Inge Thirlamarn", "Dr. Ingrid Thirlamarn"])],
    ])


def _meet(kind, a, b):
    return bool(set(V._keys(kind, V._plain(kind, a), True, "")) & set(V._keys(kind, V._plain(kind, b), False, "")))


@settings(max_examples=500, deadline=None)
@given(st.text("abcde", min_size=7, max_size=24), st.lists(st.tuples(st.sampled_from("disw"), st.integers(0, 30), st.sampled_from("abcdex")), max_size=2))
def test_persons_with_two_slips_meet(family, slips):
    """Whatever pair of long family names the channel accepts has a key in common."""
    x = family
    for op, i, c in slips:
        i %= len(x)
        x = x[:i] + {"d": x[i + 1 :], "i": c + x[i:], "s": c + x[i + 1 :], "w": x[i : i + 2][::-1] + x[i + 2 :]}[op]
    a, b = f"{family}, Ann", f"{x}, Ann"
    if N.person_cost(N.person(a), N.person(b)) is not None:
        assert _meet("person", a, b) and _meet("person", b, a)


@pytest.mark.parametrize("a,b", [
    ("Mnstry of Envrnmnt Northland", "Northland Ministry of Environment"),
    ("Board Kater of Northland Valley", "Northland Valley Water Board"),
])
def test_bodies_the_channel_accepts_meet(a, b):
    assert N.org_cost(N.org_words(a), N.org_words(b)) is not None and _meet("org", a, b) and _meet("org", b, a)


def test_variants_find_what_all_pairs_find(spark):
    """Blocking loses no pair that the channel would accept (slips in names of one scope)."""
    r = random.Random(3)
    bodies = ["Quernholm Regional District", "Seismic Hazard Survey", "Wetland Mapping Programme", "Public Lands Registry"]
    names = set(bodies)
    while len(names) < 60:
        b = list(r.choice(bodies))
        for _ in range(r.randint(1, 2)):
            i = r.randrange(1, len(b))
            b[i] = r.choice("abcdefghij")
        names.add("".join(b))
    df = spark.createDataFrame([("agency", "all", "org", v, 100 if v in bodies else 1) for v in names], "field_name string, name_scope string, kind string, value string, n bigint")
    got = clusters(V.link(df))
    # A replaced blank can glue words together; that is still within the channel's two slips.
    assert len(got) == 4 and all(sum(b in c[2] for b in bodies) == 1 for c in got)


@pytest.mark.parametrize("a,b,same", [
    ("Jacqueline Teskisko", "Jacqueline Naskisko", False), ("Jacqueline Teskisko", "Jackie Tesksko", True), ("Kwame Rhudoquist", "Benedict Rhudoquist", False),
    ("I.P. Quelulane", "Quelulane, Ingrid", True), ("Dr. Mei-Lin Yarlivane", "M. Yarrlivane", True), ("KThirlandry", "Kwame Thirlandry", True), ("Richard Vantemben, GLU - Reviews", "Dick Vantemben (GLU)", True),
])
def test_persons(a, b, same):
    assert (N.person_cost(N.person(a), N.person(b)) is not None) == same == (N.person_cost(N.person(b), N.person(a)) is not None)


def test_review_values_and_empty(spark):
    s = "agency string, author string, project string, n string"
    df = spark.createDataFrame([("A", "B", None, "z"), ("A", "-", "p", "z"), (None, " ", "p", None), ("nan", "B", "p", None)], s)
    assert {(r.field_name, r.name_scope, r.value, r.n) for r in V.review_values(df).collect()} == {("agency", "all", "A", 2), ("author", "", "B", 1), ("author", "p", "B", 1)}
    e = V.link(V.review_values(spark.createDataFrame([], s)), V.known_agencies(spark.createDataFrame([], CAN)))
    assert e.count() == 0 and V.pairs_of(e).count() == 0


def test_canonical(spark):
    vals = {
        ("agency", "M.F.L."): "Ministry of Forest Lands", ("agency", "forest lands minisrty"): "Ministry of Forest Lands", ("agency", "Council - Upper Sallow Tribal"): "Upper Sallow Tribal Council", ("agency", "Lowwer Sallow Tribal Council (North Office)"): "Lower Sallow Tribal Council",
        ("agency", "Bird Watchers"): "UNMATCHED", ("agency", "?"): "UNMATCHED", ("status", "clsd"): "Closed", ("status", "opn"): "Open", ("status", "pending."): "Open", ("status", "IP"): "In Progress", ("status", "closed - see response"): "Closed",
        ("status", "2019-01-01"): "UNMATCHED", ("status", "see email"): "UNMATCHED", ("other", "Open"): "UNMATCHED", ("agency", "x" * 5000): "UNMATCHED",
    }
    df = spark.createDataFrame(list(vals), "field_name string, raw_value string")
    got = C.match(df, spark.createDataFrame(LIST, CAN))
    assert {(r.field_name, r.raw_value): r.canonical_value for r in got.collect()} == vals and got.count() == len(vals)
    assert {r.canonical_value for r in C.match(df, spark.createDataFrame([], CAN)).collect()} == {"UNMATCHED"}
    assert C.match(df.limit(0), spark.createDataFrame(LIST, CAN)).count() == 0


@pytest.mark.parametrize("t", [0.25, 0.5, 0.8])
def test_set_join_equals_all_pairs(spark, t):
    r = random.Random(1)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(80)]
    probe = spark.createDataFrame([("f", w) for w in words[:50]] + [("g", "aa")], "f string, p string")
    index = spark.createDataFrame([("f", w) for w in words[30:]] + [("g", "bb")], "f string, r string")
    pairs = lambda s: {("^" + s + "$")[i : i + 2] for i in range(len(s) + 1)}
    want = {("f", a, b) for a in words[:50] for b in words[30:] if len(pairs(a) & pairs(b)) / len(pairs(a) | pairs(b)) >= t}
    assert {(x.f, x.p, x.r) for x in C.set_join(probe, index, "f", t).collect()} == want


def test_names_of_their_own_stay_apart(spark):
    """Two names of like and large frequency are two; the same pair with a rare second is one."""
    pairs = [
        ("person", "John Smith", 50000, "Joan Smith", 49000), ("person", "Anna Lee", 10000, "Anne Lee", 9999), ("person", "Maria Chen", 800, "Mario Chen", 800),
        ("person", "Robert Brown", 400, "Roberta Brown", 399), ("org", "North Region Office", 5000, "South Region Office", 4999), ("org", "East District Council", 700, "West District Council", 699),
    ]
    rows = [("f", f"{i}", k, v, n) for i, (k, a, na, b, nb) in enumerate(pairs) for v, n in ((a, na), (b, nb))]
    # Beside a frequent one, a rare one is a slip; small numbers say little.
    rows += [("g", f"{i}", k, v, n) for i, (k, a, _, b, _) in enumerate(pairs[2:3] + pairs[4:]) for v, n in ((a, 900), (b, 12))]
    rows += [("h", "p", "person", "Yusuf Lurdarro", 4), ("h", "p", "person", "Yusf Lurdarro", 3)]
    got = clusters(V.link(spark.createDataFrame(rows, "field_name string, name_scope string, kind string, value string, n bigint")))
    assert [len(v) for f, _, v in got if f == "f"] == [1] * 12 and [len(v) for f, _, v in got if f == "g"] == [2] * 3 and [len(v) for f, _, v in got if f == "h"] == [2]


def test_every_form_is_explained_by_its_root(spark):
    """A chain of slips that leads too far is cut."""
    chain = {"Abcdefghij Bureau": 1000, "Abcdefghik Bureau": 100, "Abcdefxhik Bureau": 20, "Abcxefxhik Bureau": 4}
    df = spark.createDataFrame([("f", "all", "org", v, n) for v, n in chain.items()], "field_name string, name_scope string, kind string, value string, n bigint")
    for r in V.link(df).collect():
        assert N.org_cost(N.org_words(r.value), r.entity.split()) is not None


def test_hot_keys_lose_nothing(spark, monkeypatch):
    """With every key hot the links are the same."""
    r = random.Random(5)
    towns = ["".join(r.choice("bcdfglmnprst") + r.choice("aeiou") for _ in range(5)) for _ in range(15)]
    rows = []
    for t in towns:
        name = f"Ministry of Works and Housing {t.title()}"
        rows.append((name, 50))
        for _ in range(3):
            b = list(name)
            for _ in range(r.randint(1, 2)):
                i = r.randrange(1, len(b))
                b[i : i + r.randint(0, 2)] = r.choice("xyz")
            rows.append(("".join(b), 1))
    df = spark.createDataFrame([("f", "all", "org", v, n) for v, n in dict(rows).items()], "field_name string, name_scope string, kind string, value string, n bigint")
    want = clusters(V.link(df))
    monkeypatch.setattr(V, "HOT", 1)
    assert clusters(V.link(df)) == want


def test_long_acronyms_link(spark):
    rows = [("f", "all", "org", "Board of Alpha Beta Gamma Delta Epsilon Zeta Eta Theta", 50), ("f", "all", "org", "BABGDEZET", 9)]
    assert len(clusters(V.link(spark.createDataFrame(rows, "field_name string, name_scope string, kind string, value string, n bigint")))) == 1

import datetime as dt

from reviewloom.operators import drift as D

M = "source_file string, project string, delivery_no int, delivered_on timestamp, sheet_name string, header_row int, n_columns int, header string"
C = "source_file string, sheet string, sheet_idx int, row_idx int, col_idx int, cell_value string, vtype string, field string"
P = "pair_id bigint, source_column string, source_file string"
N = "source_file string, data_structure string, layout string"


def book(name, heads, data):
    out = [(name, "Data", 0, 0, i, h, "str", "z") for i, h in enumerate(heads) if h is not None]
    for r, row in enumerate(data, 1):
        out += [(name, "Data", 0, r, i, v, t, None) for i, (v, t) in enumerate(row) if v is not None]
    return out


def tables(spark, books, rows=()):
    t = dt.datetime(2020, 1, 1)
    man = [(n, n[0], k, t, None if k % 2 else "Data", 0, 3, "z") for k, (n, _, _) in enumerate(books, 1)]
    cells = [c for b in books for c in book(*b)]
    return spark.createDataFrame(man, M), spark.createDataFrame(cells, C), spark.createDataFrame([], P), spark.createDataFrame(list(rows), N)


def test_changes(spark):
    s, i = (lambda *v: [(x, "str") for x in v]), ("3", "int")
    books = [
        ("p1", ["Comment ID", "Round ", "Theme", "Odd Header"], [s("A-1") + [i] + s("w", "q 1")] * 3),
        ("p2", ["Topic", "Comment ID", "Round", "Strange"], [s("w", "A-2") + [("three", "str")] + s("q 2")] * 2 + [[("-", "str"), ("A-3", "str"), i, (None, "str")]]),
        ("p3", ["Comment ID", "Comment ID", "Page", None], [s("A-1", "A-2") + [i]] * 3),
    ]
    got = {tuple(r) for r in D.changes(*tables(spark, books, [("p1", "long", ""), ("p2", "LONG", ""), ("p2", "wide", ""), ("p2", "LONG", ""), ("p3", "wide", ""), ("p3", None, "")])).collect()}
    assert got == {
        ("p2", "renamed", "Theme", "Topic"), ("p2", "renamed", "Odd Header", "Strange"), ("p2", "type_changed", "Round", "Round"),
        ("p3", "removed", "Topic", ""), ("p3", "removed", "Round", ""), ("p3", "removed", "Strange", ""), ("p3", "added", "", "Page"), ("p3", "structure_changed", "", ""),
    }


def test_every_free_header_finds_its_partner(spark):
    s = lambda *v: [(x, "str") for x in v]
    # Both new headers are most like "Odd A"; the second one's own partner is free.
    books = [("p1", ["Odd A", "Odd B"], [s("a", "a"), s("1", "a-1")]), ("p2", ["Few", "Same"], [s("a", "a"), s("a", "1")])]
    got = {tuple(r)[1:] for r in D.changes(*tables(spark, books)).collect()}
    assert got == {("renamed", "Odd A", "Same"), ("renamed", "Odd B", "Few")}


def test_long_texts_are_told_apart(spark):
    s = lambda *v: [(x, "str") for x in v]
    one, two = "The creek below the camp rises each spring", "Our laboratory repeated all assays with fresh samples"
    books = [("p1", ["Odd A", "Odd B"], [s(one, two)] * 2), ("p2", ["Strange A", "Strange B"], [s(two + " again", one + " now")] * 2)]
    got = {tuple(r)[1:] for r in D.changes(*tables(spark, books)).collect()}
    assert got == {("renamed", "Odd A", "Strange B"), ("renamed", "Odd B", "Strange A")}


def test_empty(spark):
    t = tables(spark, [])
    assert D.changes(*t).count() == 0 and D.unify(*t[:3]).count() == 0 and D.lifespans(D.catalogue(*t[:3])).count() == 0


def test_unify_keeps_other_columns(spark):
    t = tables(spark, [("p1", ["Item #", "Rec'd", "Page"], [[("A-1", "str"), ("2020-01-02 00:00:00", "datetime"), ("4", "int")]])])
    r = D.unify(*t[:3]).collect()[0]
    assert (r.comment_id, str(r.date_received), r.other, r.uncast) == ("A-1", "2020-01-02", '{"Page":"4"}', "{}")


def test_unify_loses_no_cell(spark):
    """Repeated headers, a column without one, and a cell that its cast does not take."""
    t = tables(spark, [("p1", ["Comment ID", "Notes", "Notes", "Round", None, "Comment"], [[(v, "str") for v in ("A-1", "n1", "n2", "two", "loose", "text")]] * 2)])
    r = D.unify(*t[:3]).collect()
    assert len(r) == 2 and (r[0].comment_id, r[0].round, r[0].comment_text) == ("A-1", None, "text")
    assert r[0].other == '{"Column_4":"loose","Notes#1":"n1","Notes#2":"n2"}' and r[0].uncast == '{"round":"two"}'
    assert [tuple(x)[2:] for x in D.cast_report(*t[:3]).collect()] == [("Round", "round", "int", 2, 2)]
    # Two columns of one field: the leftmost filled cell is the field's, the other is kept.
    t = tables(spark, [("p1", ["Comment", "Comments Received"], [[("a", "str"), ("b", "str")], [(None, "str"), ("c", "str")]])])
    assert sorted((r.comment_text, r.other) for r in D.unify(*t[:3]).collect()) == [("a", '{"Comments Received":"b"}'), ("c", "{}")]


def test_headers_the_table_does_not_know(spark):
    """A producer all of whose headers are foreign: the cells decide, and types count."""
    s = lambda *v: [(x, "str") for x in v]
    one = [s(f"K-{i}", f"The {w} bank was mapped twice", f"{w} crew") + [(str(i), "int")] for i, w in enumerate(("north", "south", "upper"))]
    two = [s(f"{w} crew", f"K-{i}") + [(str(i), "int")] + s(f"The {w} bank was mapped again") for i, w in enumerate(("north", "south", "lower"))]
    books = [("p1", ["Lfd", "Bemerkung", "Wer", "Blatt"], one), ("p2", ["Equipe", "Cote", "Feuille", "Remarque"], two)]
    got = {tuple(r)[1:] for r in D.changes(*tables(spark, books)).collect()}
    assert got == {("renamed", "Lfd", "Cote"), ("renamed", "Bemerkung", "Remarque"), ("renamed", "Wer", "Equipe"), ("renamed", "Blatt", "Feuille")}


def test_alias_table_is_an_input(spark):
    s = lambda *v: [(x, "str") for x in v]
    t = tables(spark, [("p1", ["Lfd"], [s("a")]), ("p2", ["Cote"], [s("1 - 2 - 3 - 4")])])
    kinds = lambda a: {r.change_kind for r in D.changes(*t, aliases=a).collect()}
    assert kinds(None) == {"added", "removed"} and kinds(D.alias_table(spark, {"no": ("lfd", "cote")})) == {"renamed"}


def test_sketches_are_bounded_and_read_whole_cells(spark):
    many = [("a", 0, " ".join(f"w{i}x{j}" for j in range(300)), "str") for i in range(50)]
    df = spark.createDataFrame([(f, c, v) for f, c, v, _ in many] + [("b", 0, "same start here but ends in 77"), ("c", 0, "same start here but ends in WORDS")], "source_file string, col_idx int, cell_value string")
    r = {x.source_file: x for x in D.sketches(df).collect()}
    assert len(r["a"].words) <= D.BUCKETS and r["b"].shapes != r["c"].shapes and r["b"].words != r["c"].words

import pytest
from pyspark.sql import functions as F

from reviewloom.common import table
from reviewloom.llm import pii
from reviewloom.llm.training import composed

S = "rec_id bigint, author string, comment_text string, response_text string, ordinal string, score string"


@pytest.fixture(scope="module")
def found(spark):
    return pii.finder(table(spark, "/root/testdata/sf0.01", "normalized_output_example"))


def kinds(f, t):
    return [(k, t[a:b]) for a, b, k, _ in f.spans([t])[0]]


def test_held_out_accuracy(found):
    """Texts composed with another seed: precision and recall of mentions per type."""
    texts = composed(found.lex, 1500, seed=77, foreign=0)
    for kind in pii.TYPES:
        hit = got = true = 0
        for (_, marks), spans in zip(texts, found.spans([t for t, _ in texts])):
            a = [m for m in marks if m[2] == kind]
            b = [s for s in spans if s[2] == kind]
            hit += sum(any(s[0] < m[1] and m[0] < s[1] for s in b) for m in a)
            got, true = got + len(b), true + len(a)
        assert hit / true >= 0.97 and hit / got >= 0.97, kind


@pytest.mark.parametrize("text,want", [
    ("Regards,\nJennifer Ostrorin The table is late.", ["name"]),
    ("Attn Ms. P. Kelloquist\nUnit 7, 7389 Sable Dr., Ivorymoor X4C 2Z3\np.kell [at] mail [dot] example", ["name", "address", "email"]),
    ("Purchase order 913-965-9512 covers the liner. Pump P-308@98 runs @ 20 kPa.", []),
    ("Collar at 477739 E, 9925864 N. Core boxes 059 550 917 were relogged.", []),
    ("ID on file: passport no. ZX650035; call (403) 555-0160 ext. 12 or 07700 900 885.", ["id_number", "phone", "phone"]),
    ("Samples from Mount Patricia and the Kellarro Formation differ. The Christopher zone hosts ore.", []),
    ("S.I.N. 002-495-457, DL# 6733-891", ["id_number", "id_number"]),
    ("Mail to P.O. Box 8798, Tealmere or 3200, rue des Wickers, Tarnfell.", ["address", "address"]),
    ("", []), ("x" * 200_000 + "@", []), ("1 " * 5_000, None),
])
def test_texts(found, text, want):
    got = [k for k, _ in kinds(found, text)]
    assert want is None or got == want


@pytest.mark.parametrize("part,end", [("a.", "@"), ("a [dot] ", "@"), ("Mr A. ", ""), ("12 a b ", " st"), ("Kwame & ", ""), ("(1", ""), ("rr 1, site ", ""), ("a-", "")])
def test_long_texts_take_linear_time(found, part, end):
    import time

    began = time.time()
    found.spans([part * (200_000 // len(part)) + end])
    assert time.time() - began < 10


def test_rows_nulls_repeats_and_clashing_names(spark, found):
    t = "call 403-555-0160 or 403-555-0161"
    df = spark.createDataFrame([(1, None, t, None, "a", "b"), (1, None, t, "", "a", "b"), (None, "x", None, t, None, None), (2**60 + 1, "x", None, t, None, None)], S)
    got = sorted(((r.rec_id or 0), r.field_name, r.pii_type, r.ordinal) for r in pii.mentions(df, use=found).collect())
    assert got == sorted([(1, "comment_text", "phone", i) for i in (1, 2)] * 2 + [(k, "response_text", "phone", i) for k in (0, 2**60 + 1) for i in (1, 2)])
    clean = pii.redact(df, use=found).collect()
    assert clean[0].comment_text == "call [PHONE] or [PHONE]" and clean[0].response_text is None and clean[1].response_text == "" and clean[0].ordinal == "a"


def test_short_family_names_and_lower_case_nicknames():
    """Proposed beside a title, an initial or a given name, not bare."""
    lex = pii.Lexicon.of({"maria": 3}, {"ng": 1, "lee": 1, **{f"{a}{b}": 1 for a in ("thirl", "kello") for b in ("quist", "amark")}})
    spans = lambda t: [t[a:b] for a, b, k, _ in pii.proposals(t, lex) if k == "name"]
    for t in ("Dr. Ng", "J. Ng", "Maria Ng", "Ng, Maria", "Dr. Wu", "Maria Lee", "maria lee"):
        assert spans(f"Noted with {t} there.") == [t]
    assert spans("Noted: ask bob sableamark there.") == ["bob sableamark"]
    assert spans("Ng noted it. Lee noted it.") == [] and spans("Maria On the whole.") in ([], ["Maria"])


def test_lexicon_keeps_every_name(spark):
    """More different names than 200,000, each with one bearer."""
    name = F.concat(F.lit("Q"), F.translate(F.lpad(F.col("id").cast("string"), 6, "0"), "0123456789", "bcdfghjklm"))
    rows = spark.range(0, 200_002, numPartitions=8).select(F.concat(F.lit("Maria "), name).alias("author"))
    assert len(pii.lexicon(rows).family) == 200_002


def test_empty_table(spark):
    df = spark.createDataFrame([], S)
    assert pii.mentions(df).count() == 0 and pii.redact(df).count() == 0


def marked():
    """The independent texts without their marks, and the marks' spans."""
    import re

    from independent import TEXTS

    out = []
    for line in TEXTS.split("\n"):
        line = line.replace("|", "\n")
        text, marks, at = "", [], 0
        for m in re.finditer(r"\[(name|email|phone|address|id_number) ([^\]]+)\]", line):
            text += line[at : m.start()]
            marks.append((len(text), len(text) + len(m[2]), m[1]))
            text, at = text + m[2], m.end()
        out.append((text + line[at:], marks))
    return out


def scores(found):
    """(right, found, true) over the independent texts; a mention is right if type and most of the span agree."""
    hit = got = true = 0
    misses = []
    for (t, marks), spans in zip(marked(), found.spans([t for t, _ in marked()])):
        right = [m for m in marks if any(k == m[2] and min(b, m[1]) - max(a, m[0]) >= 0.6 * (m[1] - m[0]) for a, b, k, _ in spans)]
        hit, got, true = hit + len(right), got + len(spans), true + len(marks)
        if len(right) < max(len(marks), len(spans)):
            misses.append((t, [(k, t[a:b]) for a, b, k, _ in spans]))
    return hit, got, true, misses


def test_independent_texts(found):
    """Names of no list, of other origins, in sentences that no training text has."""
    hit, got, true, misses = scores(found)
    assert hit / true >= 0.8 and hit / got >= 0.95, misses


@pytest.mark.parametrize("text,want", [
    ("Please forward to Nguyen Thi Hoa", "Nguyen Thi Hoa"), ("I am Oluwaseun Adebayo", "Oluwaseun Adebayo"), ("My name is Björk Guðmundsdóttir", "Björk Guðmundsdóttir"),
    ("Contact Xiaoling", "Xiaoling"), ("Sincerely, Pradeep Kumar Venkataraman", "Pradeep Kumar Venkataraman"), ("SSN 123-45-6789", "123-45-6789"), ("my SSN is 078-05-1120", "078-05-1120"),
])
def test_names_of_no_list(found, text, want):
    assert [s for _, s in kinds(found, text)] == [want]


def test_no_training_sentence_is_in_the_tables(spark):
    """Sentences of twelve fixed characters and more, holes aside."""
    import re

    from reviewloom.llm import training

    rows = table(spark, "/root/testdata/sf0.01", "normalized_output_example").select("comment_text", "response_text").toPandas()
    texts = "\n\n".join(re.sub(r"\s+", " ", t) for c in rows for t in rows[c].dropna())
    for form in (training.WITH + "\n" + training.WITHOUT + "\n" + training.FILL).split("\n"):
        parts = re.split(r"\{\w+\}", form.replace("|", " "))
        if sum(map(len, parts)) >= 12:
            assert max(parts, key=len) not in texts or not re.search(".{1,60}?".join(map(re.escape, parts)), texts), form


def test_model_is_fitted_once_and_saved(spark, found, tmp_path):
    rows = table(spark, "/root/testdata/sf0.01", "normalized_output_example")
    assert pii.finder(rows) is pii.finder(rows)
    pii.save(found, spark, (tmp_path / "m").as_uri())
    again = pii.load(spark, (tmp_path / "m").as_uri())
    texts = [t for t, _ in marked()]
    assert again.spans(texts) == found.spans(texts)

"""Value rules as Column -> Column expressions; all run inside generated code.

Unless said otherwise a null gives '' where the rule is about text, and white
space around a value does not count.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewloom import rulesdata as R


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def let(value: Column, body) -> Column:
    """body(value) with value computed once, which keeps nested rules small."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def first_group(c: Column, pattern: str, group: int = 1) -> Column:
    """The group's text, or null where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def agency_from_id(c: Column) -> Column:
    """The code before the number in an identifier; digits alone give ''."""
    v = strip(c)
    return F.when(v.isNull() | v.rlike(r"^[0-9]+$"), "").otherwise(F.coalesce(*[first_group(v, p) for p in R.ID_PATTERNS], F.lit("")))


def numeric_id(c: Column, vtype: Column) -> Column:
    """Identifiers of number cells without their fraction; other cells stripped."""
    return F.when(c.isNull(), "").when(vtype.isin("int", "float"), c.try_cast("double").cast("bigint").cast("string")).when(vtype == "bool", F.when(F.lower(c) == "true", "1").otherwise("0")).otherwise(strip(c))


def _abbreviations() -> list[str]:
    return sorted(set(R.AGENCY_NAMES.values()), key=lambda a: (-len(a), a))


def has_word(v: Column, word: str) -> Column:
    return v.rlike(rf"(?i)(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)")


def _agency_once(v: Column) -> Column:
    low = F.lower(v)
    known = F.create_map(*[F.lit(x) for kv in R.AGENCY_NAMES.items() for x in kv])
    full = F.coalesce(*[F.when(low.contains(n.lower()), F.lit(a)) for n, a in R.AGENCY_NAMES.items()])
    # One look for any code spares most values the search for each.
    word = F.when(has_word(v, f"({'|'.join(_abbreviations())})"), F.coalesce(*[F.when(has_word(v, a), F.lit(a)) for a in _abbreviations()]))
    words = F.filter(F.split(v, r"\s+"), lambda w: (F.length(w) > 2) & ~F.lower(w).isin(*R.ACRONYM_SKIP))
    acronym = F.array_join(F.transform(F.slice(words, 1, 4), lambda w: F.upper(F.substring(w, 1, 1))), "")
    cut = F.upper(F.substring(v, 1, 4))
    return (
        F.when(v.isin(*_abbreviations()), v)
        .otherwise(F.coalesce(
            F.try_element_at(known, v), full, word,
            F.when(v.rlike(r"^\p{Lu}{1,4}$"), v),
            F.when(F.length(acronym) == 1, v).when(F.length(acronym) > 1, acronym),
            F.when(F.length(cut) == 1, v).otherwise(cut),
        ))
    )


def agency_code(c: Column) -> Column:
    """Abbreviation of a body, by dictionary, whole-word code or initials; applied twice."""
    once = let(strip(c), _agency_once)
    return F.when(c.isNull(), "").otherwise(let(strip(once), _agency_once))


def agency_from_author(c: Column) -> Column:
    """C4: a known abbreviation standing as a word, longest first, then by name."""
    any_code = has_word(c, f"({'|'.join(_abbreviations())})")
    return F.coalesce(F.when(any_code, F.coalesce(*[F.when(has_word(c, a), F.lit(a)) for a in _abbreviations()])), F.lit(""))


_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
# Date layouts in order, as pattern and places of year, month and day; the tail holds further ones.
DATE_LAYOUTS = (
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2), (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1), (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 1, 2),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3), (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1), (r"^(\d{4})(\d{2})(\d{2})$", 1, 2, 3),
    (r"^(\d{4})-(\d{2})-(\d{2})[ T]\d{2}:\d{2}(?::\d{2}(?:\.\d+)?)?$", 1, 2, 3), (r"^(\d{1,2})-(\d{1,2})-(\d{2})$", 3, 1, 2), (r"^(\d{1,2})/(\d{1,2})/(\d{2})$", 3, 1, 2),
)
NAMED_LAYOUTS = ((r"^([A-Za-z]{3,9})\.? (\d{1,2}),? (\d{4})$", 3, 1, 2), (r"^(\d{1,2}) ([A-Za-z]{3,9})\.?,? (\d{4})$", 3, 2, 1))


def parse_date(c: Column) -> Column:
    """The first layout that reads a value, as a date; month before day where both fit."""
    return let(strip(c), _read_date)


def _read_date(v: Column) -> Column:
    def layout(p: str, y: int, m: int, d: int, named: bool) -> Column:
        year = F.regexp_extract(v, p, y)
        year = F.when(F.length(year) == 2, F.concat(F.when(year < "69", "20").otherwise("19"), year)).otherwise(year)
        month = F.regexp_extract(v, p, m)
        if named:
            at = F.instr(F.lit(_MONTHS), F.lower(F.substring(month, 1, 3)))
            month = F.when((at > 0) & (at % 3 == 1), ((at + 2) / 3).cast("int").cast("string"))
        text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(F.regexp_extract(v, p, d), 2, "0"))
        return F.when(v.rlike(p), F.try_to_date(text, "yyyy-MM-dd"))

    return F.coalesce(*[layout(*x, False) for x in DATE_LAYOUTS], *[layout(*x, True) for x in NAMED_LAYOUTS])


def standard_date(c: Column) -> Column:
    """YYYY-MM-DD, or the text itself where no layout reads it."""
    return F.when(c.isNull(), "").otherwise(F.coalesce(F.date_format(parse_date(c), "yyyy-MM-dd"), c))


def _by_dictionary(c: Column, words: dict[str, str]) -> Column:
    v = strip(c)
    low = F.lower(v)
    exact = F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), low)
    part = [F.when(low.contains(k), F.lit(x)) for k, x in words.items()]
    return F.when(c.isNull(), "").otherwise(F.coalesce(exact, *part, v))


def status(c: Column) -> Column:
    """By exact word, then by the first contained one, else as it stands."""
    return _by_dictionary(c, R.STATUSES)


def comment_type(c: Column) -> Column:
    """C7."""
    return _by_dictionary(c, R.COMMENT_TYPES)


def round_number(c: Column) -> Column:
    """The first pattern's number, else the value."""
    low = F.lower(c)
    return F.when(c.isNull(), "").otherwise(F.coalesce(*[first_group(low, p) for p in R.ROUND_PATTERNS], strip(c)))


def author(c: Column) -> Column:
    """Single blanks, titles removed once each."""
    v = strip(F.regexp_replace(c, r"\s+", " "))
    for t in R.AUTHOR_TITLES:
        v = F.regexp_replace(v, rf"^{re.escape(t)}\s*", "")
    return F.coalesce(v, F.lit(""))


_ROUND_IN_ID = (r"(?i)[-_\s]R(\d+)(?=[-_\s.]|$)", r"(?i)[-_\s]Round\s*(\d+)(?=[-_\s.]|$)")


def id_round(c: Column) -> Column:
    """The round number set into an identifier, else null."""
    v = strip(c)
    return F.coalesce(*[first_group(v, p) for p in _ROUND_IN_ID]).try_cast("int")


def base_id(c: Column) -> Column:
    """The identifier without its round; the first place of the matched text is cut."""
    v = strip(c)
    hit = F.coalesce(*[first_group(v, p, 0) for p in _ROUND_IN_ID])
    at = F.instr(v, hit)
    return F.when(hit.isNull(), v).otherwise(strip(F.concat(F.substring(v, F.lit(1), at - 1), F.substring(v, at + F.length(hit), F.length(v)))))


def column_name(c: Column) -> Column:
    """C11: lower case, other marks as blanks, single blanks."""
    return strip(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9\s]", " "), r"\s+", " "))


def first_answer(c: Column) -> Column:
    """Yes or No among the first five characters, else ''."""
    v = F.lower(F.substring(c, 1, 5))
    return F.when(v.contains("yes"), "Yes").when(v.contains("no"), "No").otherwise("")


def any_answer(c: Column) -> Column:
    """C14: Yes or No anywhere, else Unknown."""
    v = F.lower(c)
    return F.when(v.contains("yes"), "Yes").when(v.contains("no"), "No").otherwise("Unknown")


def last_line_answer(c: Column) -> Column:
    """The answer on the last filled line, for judges that reason first."""
    return any_answer(F.regexp_extract(F.coalesce(c, F.lit("")), r"([^\n]*\S[^\n]*)\s*$", 1))


def round_group(r: Column) -> Column:
    """1, 2, 3+; other numbers are null."""
    return F.when(r >= 3, "3+").when(r == 1, "1").when(r == 2, "2")


def round_label(r: Column) -> Column:
    """r1, r3plus or other."""
    return F.when(r == 1, "r1").when(r >= 3, "r3plus").otherwise("other")


def days_between(a: Column, b: Column) -> Column:
    """C17: days from a to b with their fraction."""
    return (F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))) / 86_400_000_000.0


def whole_days(a: Column, b: Column, existing: Column | None = None) -> Column:
    """Whole days, only where no number exists yet."""
    d = F.floor(days_between(a, b)).cast("double")
    return d if existing is None else F.coalesce(existing, d)


def to_number(c: Column) -> Column:
    """A plain number, else null."""
    return F.when(c.rlike(r"^\s*[+-]?[0-9]+(\.[0-9]+)?\s*$"), strip(c).try_cast("double"))


def to_date(c: Column) -> Column:
    """An ISO date, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"


def first_number(c: Column) -> Column:
    """The first number of a text, thousands separators aside."""
    v = F.replace(c, F.lit(","), F.lit(""))
    return F.when(v.rlike(NUMBER), F.regexp_extract(v, NUMBER, 0).try_cast("double"))


def answers_match(given: Column, actual: Column, tolerance: float = 0.01) -> Column:
    """Numbers decide where both sides have one; else equal text, or the actual within the given."""
    a, b = first_number(given), first_number(actual)
    x, y = (strip(F.lower(F.coalesce(c, F.lit("")))) for c in (given, actual))
    return F.when(a.isNotNull() & b.isNotNull(), F.abs(a - b) <= tolerance).otherwise((x == y) | ((y != "") & F.contains(x, y)))


def sample_text(cols: list[Column]) -> Column:
    """The filled samples, cut to length, joined."""
    cut = lambda s: F.when(F.length(s) > R.SAMPLE_CHARS, F.concat(F.substring(s, 1, R.SAMPLE_CHARS), F.lit("..."))).otherwise(s)
    return F.array_join(F.transform(samples_key(cols), cut), ", ")


def samples_key(cols: list[Column]) -> Column:
    """The filled samples as an array."""
    return F.filter(F.array(*[strip(c) for c in cols]), lambda s: s.isNotNull() & (s != "") & (s != "nan"))


def description(c: Column) -> Column:
    """By the first contained header word, kinds in order."""
    low = F.lower(c)
    parts = [F.when(F.greatest(*[low.contains(w) for w in ws]), F.lit(R.DESCRIPTIONS[k])) for k, ws in R.HEADER_WORDS.items()]
    return F.coalesce(*parts, F.concat(F.lit("Data column containing "), low, F.lit(" information")))


def project_name(path: Column) -> Column:
    """The file's name without .xlsx."""
    return F.replace(F.element_at(F.split(path, "/"), -1), F.lit(".xlsx"), F.lit(""))


def fallback_target(header: Column) -> Column:
    """The target of a well-known header, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in R.FALLBACK_HEADERS.items() for x in kv]), header)


def clean_response(c: Column, echo: str = "") -> Column:
    """A model's text without white space around it and without an echoed instruction."""
    v = strip(c)
    return strip(F.replace(v, F.lit(echo), F.lit(""))) if echo else v

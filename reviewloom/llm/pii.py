"""Personal details in free text, found by boosted trees over proposed spans.

Generous generators propose spans: e-mail addresses (spelled out or not),
numbers that may be phones or identity numbers, street, box and rural-route
addresses, and sequences of words that may name a person. Spans may overlap and
one span may be proposed under two types. Boosted trees, one per type, score
format and context features; a Platt calibration and a threshold chosen on
held-out candidates decide, and of overlapping spans the most probable stays.

The name generator knows given and family names from the author column: counts
over all rows, and from them the beginnings and endings of family names. Names
on no list are proposed by their shape: capital words behind a title or a cue
(`contact`, `my name is`, `by`), in every length, so spans overlap; membership in
the lists is a feature there. The trees are fitted on `SAMPLE` labelled texts that
`training.py` composes; sentences and name origins that the trees had not seen
decide calibration and thresholds. The bound is a parameter and does not depend on the
data. A fitted model serves every query of a session and can be saved.

Null and empty texts have no mentions. Whole texts are read, of any length.
Repeated rows are judged each for itself; a null key stays null. Other columns are
kept by `redact` and ignored by `mentions`, whatever their names. Without any author only titles and
initials mark names.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom.common import is_empty
from reviewloom.llm import names as N
from reviewloom.llm.boost import Boost

TYPES = ("email", "phone", "id_number", "address", "name")
SAMPLE = 8000

# Words that tell a proper noun's kind, and cues around mentions.
PLACE = frozenset("lake creek slough river valley ridge bluff gulch canyon flats bench narrows plateau bay harbour point island mountain hill pass falls glacier road street crossing bridge trail village city district deposit basin watershed".split())
FIRM = frozenset("ltd inc co corp llp llc limited company consulting consultants drilling engineering laboratories laboratory labs surveying surveys services associates partners group sons mining resources environmental geotechnical contracting analytics".split())
THING = frozenset("method methods formula equation index test model zone zones vein lode ore orebody shaft pit adit fault formation member group intrusion number curve sampler gauge scale criterion correction diagram plot procedure coefficient".split())
BEFORE_PLACE = frozenset("mount mt lake fort port cape river creek point".split())
CUE = frozenset("by of to with from attn attention cc per contact regards signed thanks sincerely witness beside holder joindre de according spoke trapper as and behalf neighbour resident behind respectfully meet ask asked call dear landowner".split())
VERB = frozenset("wrote asked pointed lives holds said says states noted requests attended attend dissenting pers reports confirmed will farms believes of at and about".split())
PHONE_CUE = frozenset("call tel telephone phone ring cell mobile fax reach reachable on tried au gave or text dial ext number or and".split())
ID_CUE = frozenset("ssn passport dl sin insurance card certificate driver drivers permis assurance health phn status birth naissance passeport s.i.n".split())
NOT_PERSON = frozenset("order purchase permit water logger pump valve core boxes build version release batch ticket docket file invoice easting northing collar po photo img tender account serial model well hole station parcel lot plan".split())
# Words that open a sentence and so end a name before it.
OPENERS = frozenset(
    "a about above absent across after again all along also although an and another any as at attn before below between beyond both but by cc call clarify collar compare confirm contact de describe despite detail discuss during each "
    "even every explain field figure for from further given he here how however i identify if in is it its kindly later list locate logged map may meeting my near no not note noted notes notices of on once one or our over per permit "
    "photo please provide pump reconcile regards reply results samples section see send sheet show signed since so some state still submit table taken tel tell thanks that the their then there these they this those to under until "
    "veuillez water we what when where whether while why will with within without witness you your".split()
)
# What stands before a person who is named or speaks, weaker words that may, words inside names, and words that name an office.
_STRONG = r"my\s+name\s+is|this\s+is|i\s+am|i'm|contact|sincerely|truly|regards|forward(?:ed)?(?:\s+(?:this|it))?\s+to|attn|attention|signed|dear|thanks|behalf\s+of|ask(?:ed)?|call(?:ed)?|cc|prepared\s+for|submitted\s+by|name|neighbour|reach|met|meet|spoke\s+with"
_STRONG_END = re.compile(rf"(?i)\b(?:{_STRONG})[\s,:–-]*$")
_WEAK = frozenset("by from with to for of per de and".split())
_BETWEEN = frozenset("de da do dos la van von der den bin al del di ter y e".split())
_OFFICE = frozenset("office branch desk department board committee council team division registry ministry agency authority commission bureau unit service institute nation band club association".split())
_CAP = r"[A-ZÀ-ÖØ-Þ][\w'’.-]*"
_RUN = re.compile(rf"{_CAP}(?:[ \u00a0](?:(?:de|da|la|van|von|der|bin|al|del|di)[ \u00a0])*{_CAP}){{0,4}}")
_LAST = re.compile(r"([^\W\d_]+)\.?[\s,:–-]{1,4}$")
# The last words of cues.
_LEADS = frozenset("is am contact sincerely truly regards to attn attention signed dear thanks of ask asked call called cc for by name neighbour reach met meet with from per de and".split())
_TITLE_WORDS = frozenset("mr mrs ms dr prof professor".split())
# Words, units and elements of two letters that stand beside names and are none.
_BRIEF_WORDS = frozenset("am be do go me up us ok re vs pm et du de la le il un ce se si en au ag cu pb zn fe mn mo ni co cd cr hg kg km cm mm ml mg ha st rd dr mr ms".split())
_LETTERED = frozenset("appendix section table figure zone phase item part annex schedule area plate sheet option class type grade".split())
STREETS = r"(?:street|st|avenue|ave|road|rd|drive|dr|lane|ln|boulevard|blvd|crescent|cres|trail|way|court|ct|place|pl|highway|hwy|terrace|close|circle|row)"

_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_S = r"[\s ]"
_AT = rf"(?:{_S}?@{_S}?|{_S}*[\[(]{_S}*at{_S}*[\])]{_S}*)"
_DOT = rf"(?:\.|{_S}*[\[(]{_S}*dot{_S}*[\])]{_S}*)"
EMAIL = re.compile(rf"(?i)(?<![\w+%.-])[a-z0-9][\w+%-]*(?:{_DOT}[\w+%-]+){{0,30}}{_AT}[a-z0-9][\w-]*(?:{_DOT}[a-z][\w-]*)*")
NUMBER = re.compile(r"(?:(?<![\w.])[A-Z]{1,2}[ -]?)?(?<![\d@])(?:\+|\()?\d(?:[\s ().‑–/-]{0,3}\d){5,15}")
_EXT = re.compile(rf"{_S}*(?:ext\.?|x|poste){_S}*\d{{1,5}}", re.I)
_POSTAL = rf"(?:,?{_S}+[a-z]\d[a-z]{_S}?\d[a-z]\d)?"
_NOMAIL = rf"(?![\w'’-]*(?:[@_+\d]|\.\w|{_S}?@|{_S}*[\[(]{_S}*(?:at|dot)))"
_TOWN = rf"(?:(?:,{_S}*|{_S}*\n{_S}*){_NOMAIL}[^\W\d_][\w'’-]+|{_S}+[^\W\d_][\w'’-]+(?={_S}+[a-z]\d[a-z]{_S}?\d[a-z]\d))?"
ADDRESS = re.compile(
    rf"(?i)(?<![\w.@/-])(?:(?:unit|apt|suite|no|#)\.?{_S}*\d+[a-z]?,?{_S}+)?\d{{1,5}}(?:{_S}?-{_S}?\d{{1,5}})?,?{_S}+"
    rf"(?:on{_S}+)?(?:rue{_S}+(?:des|de{_S}la|de|du|la|le){_S}+[\w'’-]+|[^\W\d_][\w'’-]+(?:{_S}+[^\W\d_][\w'’-]+)?{_S}+{STREETS}\b\.?){_TOWN}{_POSTAL}"
    rf"|\bno\.{_S}*\d+{_S}+on{_S}+[^\W\d_][\w'’-]+{_S}+{STREETS}\b\.?(?:{_S}+in{_S}+[^\W\d_][\w'’-]+)?{_POSTAL}"
    rf"|\bp\.?{_S}?o\.?{_S}*box{_S}+\d+{_TOWN}{_POSTAL}"
    rf"|\b(?:r\.?r\.?|rural{_S}+route){_S}*#?\d+(?:,?{_S}+(?:site|comp|box){_S}+\d+)*{_TOWN}{_POSTAL}"
)
_STREET = re.compile(rf"(?i)([^\W\d_][\w'’-]+){_S}+({STREETS})\b")
# A cheap test that a text can hold a phone or identity number.
_LONG_NUMBER = re.compile(r"\d(?:[\s ().‑–/-]{0,3}\d){5}")


@dataclass
class Lexicon:
    """Given and family names, and what family names begin and end with."""

    given: frozenset[str] = frozenset()
    family: frozenset[str] = frozenset()
    heads: frozenset[str] = frozenset()
    tails: frozenset[str] = frozenset()
    known: frozenset[str] = field(default_factory=frozenset)
    short: frozenset[str] = field(default_factory=frozenset)
    # Listed family names of two or three letters; they count beside a title, an initial or a given name only.
    brief: frozenset[str] = field(default_factory=frozenset)

    @classmethod
    def of(cls, given: dict[str, int], family: dict[str, int]) -> Lexicon:
        """From numbers of different bearers; heads and tails need two family names each."""
        short = frozenset(w for ns in N.NICKNAMES.values() for w in ns.split())
        short = frozenset(w for w in short if len(w) > 2)
        giv = frozenset(g for g in given if len(g) > 2 and given[g] >= 2) | frozenset(N.NICKNAMES) | short
        fam = frozenset(f for f in family if len(f) > 3 and f not in giv)
        heads, tails = defaultdict(int), defaultdict(int)
        for f in fam:
            heads[f[:4]] += 1
            tails[f[-4:]] += 1
        ok = lambda d: frozenset(k for k, n in d.items() if n >= 2)
        # For the quick test, hyphenated names by their longest parts.
        return cls(giv, fam, ok(heads), ok(tails), frozenset(max(w.split("-"), key=len) for w in (giv - short) | fam), short, frozenset(f for f in family if 2 <= len(f) <= 3 and f not in giv))

    def kind(self, word: str, low: str) -> str:
        """G given, F listed family, M formed like one, '' neither; hyphenated words by their parts."""
        if low in self.given:
            return "G"
        if low in self.family:
            return "F"
        if "-" in low:
            kinds = [self.kind(p, p) for p in low.split("-") if p]
            return "" if "" in kinds or not kinds else "G" if all(k == "G" for k in kinds) else "M" if "M" in kinds else "F"
        if len(low) >= 6 and low[:4] in self.heads and low[-4:] in self.tails:
            return "M"
        return ""


def lexicon(rows: DataFrame, column: str = "author") -> Lexicon:
    """Names by role from all filled authors.

    Different authors are parsed once each. What reaches the driver is the whole
    vocabulary, a row per role and word, one partition at a time.
    """

    @F.pandas_udf("array<struct<role:string,word:string>>")
    def roles(s: pd.Series) -> pd.Series:
        out = []
        for x in s:
            r = N.person(x)[:1]
            out.append([(k, w) for g, f, _ in r for k, w in (("given", g), ("family", f)) if len(w) > 1])
        return pd.Series(out, dtype=object)

    a = rows.select(F.trim(F.col(column)).alias("a")).where(~is_empty(F.col("a"))).distinct()
    words = a.select(F.explode(roles("a")).alias("r")).groupBy("r.role", "r.word").agg(F.count("*").alias("n"))
    by: dict[str, dict[str, int]] = {"given": {}, "family": {}}
    for r in words.toLocalIterator(prefetchPartitions=True):
        by[r.role][r.word] = r.n
    # A word that is mostly a family name is one, however it was typed once.
    given = {w: n for w, n in by["given"].items() if n >= by["family"].get(w, 0)}
    return Lexicon.of(given, {w: n for w, n in by["family"].items() if w not in given})


# ------------------------------------------------------------------ candidates


_SENTENCE = re.compile(r"[.!?]\s+(?=[^\W\d_a-z])|\n|\d(?=\s)")


def _words_before(t: str, at: int, n: int) -> list[str]:
    """The last n words of the same sentence, no number between, in lower case."""
    s = _SENTENCE.split(t[max(0, at - 48) : at])[-1]
    return [w.lower() for w in _WORD.findall(s)][-n:]


def _words_after(t: str, at: int, n: int) -> list[str]:
    return [w.lower() for w in _WORD.findall(t, at, min(len(t), at + 40))][:n]


def emails(t: str) -> list:
    out = []
    for m in EMAIL.finditer(t):
        s = m.group()
        local, domain = re.split(_AT, s, maxsplit=1, flags=re.I)
        labels = [x for x in re.split(_DOT, domain, flags=re.I) if x]
        out.append((m.start(), m.end(), "email", [
            len(labels), len(labels[-1]) if labels else 0, any(c.isdigit() for c in labels[-1]) if labels else 1,
            any(c.isalpha() for c in local), sum(c.isalpha() for c in local), "[" in s or "(" in s, " " in s, "." in local, len(s),
        ]))
    return out


# What stands right before an identity number.
_ID_LEAD = re.compile(
    r"(?i)(?:passport|passeport|\bs\.?i\.?n\b\.?|social\s+insurance|social\s+security|\bssn\b|health\s+(?:card|insurance)|\bphn\b|status\s+card|(?:driver\S{0,6}|driving)\s+licen[cs]e|\bdl\b|birth\s+certificate|permis\s+de\s+conduire|\bnas\b|assurance\s+sociale)"
    r"\W*(?:no\b|number|num\b|n°)?\W*(?:is\b)?\W*$"
)


def numbers(t: str) -> list:
    out = []
    for m in NUMBER.finditer(t):
        a, b = m.span()
        s = m.group()
        if s[0] in "(" and ")" not in s:
            a += 1
            s = s[1:]
        digits = [c for c in s if c.isdigit()]
        # A line break or double gap before a new plus or bracket is another number.
        groups = [len(g) for g in re.findall(r"\d+", s)]
        before, after = _words_before(t, a, 4), _words_after(t, b, 1)
        lead = s[0].isalpha()
        near = set(before[-2:])
        cue = set(before) | ({"sin"} if re.search(r"(?i)s\.?\s?i\.?\s?n\.?[\s#:]*$", t[max(0, a - 10) : a]) else set())
        near |= cue & {"sin"}
        nanp = groups in ([3, 3, 4], [1, 3, 3, 4]) or (groups == [10]) or (groups == [11] and s[0] in "1+")
        x = [
            len(digits), len(groups), groups[0], groups[-1], s[0] == "+", "(" in s, "." in s, "/" in s, "-" in s or "‑" in s, nanp,
            groups == [3, 4], max(groups) == 1, s[0] == "0" or s.startswith("+44") or s.startswith("44"), lead, len(digits) in (9,), groups == [3, 3, 3],
            bool(cue & ID_CUE), bool(near & ID_CUE), bool(near & PHONE_CUE), bool(near & NOT_PERSON),
            a > 0 and (t[a - 1].isalnum() or t[a - 1] in "@_-"), bool(after) and after[0] in ("e", "n", "m", "kpa", "mm", "km", "ha"), b < len(t) and t[b] in "@%", bool(_ID_LEAD.search(t, max(0, a - 40), a)), groups == [4, 6],
            bool(near & {"water", "permit", "order", "logger"}), bool(cue & {"passport", "birth", "health", "status", "driver", "driver's", "social", "sin", "dl", "passeport"}), groups[:2] in ([2, 1], [2, 2], [1, 1]), groups == [3, 2, 4], bool(cue & {"ssn", "security"}), s.count("."), bool(near & {"collar", "at"}),
        ]
        e = _EXT.match(t, b)
        if not lead or s[1:3].strip() != s[1:3]:
            out.append((a, e.end() if e else b, "phone", x))
        out.append((a, b, "id_number", x))
    return out


def addresses(t: str) -> list:
    out = []
    for m in ADDRESS.finditer(t):
        s = m.group()
        words = _WORD.findall(s)
        low = s.lower()
        street = _STREET.search(s)
        if street and street[1][0].islower() and street[2][0].isupper():
            continue  # "in 2015, according to Dr. X"
        before, after = _words_before(t, m.start(), 2), _words_after(t, m.end(), 1)
        first = re.search(r"\d+", s)
        out.append((*m.span(), "address", [
            len(s), len(words), len(first.group()), "," in s or "\n" in s, "box" in low and "o" in low, low.startswith("r"), low.startswith("unit"), "rue" in low,
            bool(re.search(rf"(?i)[a-z]\d[a-z]{_S}?\d[a-z]\d$", s)), street is not None and street[1][0].isupper(), street is not None and street[1].isupper(),
            bool(words) and words[-1][0].isupper(), bool(before) and before[-1] in ("from", "at", "to", "of", "is", "and", "house"),
            bool(before) and before[-1] in ("km", "shows", "table", "figure", "sheet", "photo", "section"),
            bool(after) and after[0] in ("crossing", "culverts", "culvert", "bridge", "gate", "grade", "km"), street is not None and street[1].lower() in ("haul", "access", "service", "mine", "site", "camp"),
        ]))
    return out


def people(t: str, lex: Lexicon) -> list:
    """Sequences of words that may name a person."""
    tok = [(m.group(), m.start(), m.end()) for m in _WORD.finditer(t)]
    low = [N.fold(w) if not w.isascii() else w.lower() for w, _, _ in tok]
    # A possessive ending is no part of the name.
    for i, w in enumerate(low):
        if w.endswith(("'s", "’s")):
            low[i] = w[:-2]
            tok[i] = (tok[i][0][:-2], tok[i][1], tok[i][2] - 2)
    kinds = []
    for (w, _, end), x in zip(tok, low):
        if x in N.TITLES and x not in ("sir", "miss", "madam"):
            kinds.append("T" if w[0].isupper() else "")
        elif len(w) == 1:
            kinds.append("I" if w.isupper() and not (w == "I" and t[end : end + 1] != ".") else "")  # not the pronoun
        else:
            k = lex.kind(w, x)
            kinds.append(k)
    n, out, i = len(tok), [], 0
    for a in range(n - 1):
        if low[a] == "p" and low[a + 1] in ("o", "box"):
            kinds[a] = kinds[a + 1] = ""
        if low[a : a + 3] == ["s", "i", "n"]:
            kinds[a : a + 3] = [""] * 3

    def gap(a: int, b: int, after: str) -> bool:
        g = t[tok[a][2] : tok[b][1]]
        return len(g) <= 6 and (not g.strip() or (after in ("T", "I") and g.strip() == ".")) and ("\n\n" not in g)

    def cap(a: int) -> bool:
        w = tok[a][0]
        return w[0].isupper() and (len(w) > 2 or low[a] in lex.brief or (len(w) == 2 and w[1].islower() and low[a] not in _BRIEF_WORDS)) and low[a] not in PLACE and low[a] not in FIRM and low[a] not in THING and low[a] not in OPENERS

    def features(i: int, start: int, j: int, title: bool, initial: bool, given: bool, fam: str, comma: bool, shape: bool) -> list:
        """Of tokens i to j; start is the first after a title, fam the kind of the family name."""
        a, b = tok[i][1], tok[j][2]
        words = [tok[x][0] for x in range(start, j + 1)]
        lower = all(w.islower() for w in words)
        before = low[max(0, i - 2) : i]
        nxt = low[j + 1] if j + 1 < n and tok[j + 1][1] - b <= 3 else ""
        nxt2 = low[j + 2] if nxt and j + 2 < n else ""
        tail = t[b : b + 8]
        head = t[max(0, a - 3) : a]
        touches = not t[tok[i - 1][2] : a].strip() if i else False
        amp = tail.lstrip().startswith("&")
        after_amp = ""
        if amp:
            q = j + 1 + (low[j + 1] == "amp" if j + 1 < n else 0)
            after_amp = kinds[q] if q < n else ""
        prev_cap = i > 0 and tok[i - 1][0][0].isupper() and a - tok[i - 1][2] <= 2 and "." not in t[tok[i - 1][2] : a] and "," not in t[tok[i - 1][2] : a]
        x = [
            j - start + 1, title, initial, given, fam == "F", fam == "M", fam == "C", comma, all(w.isupper() for w in words), lower,
            nxt in PLACE, nxt in FIRM, nxt in THING, touches and before[-1] in BEFORE_PLACE, touches and before[-1] == "the",
            not head.strip() or "\n" in head, head.rstrip()[-1:] in (":", "(", ";"), head.rstrip()[-1:] == ",", bool(before) and before[-1] in CUE, bool(set(before) & CUE),
            nxt in VERB, given and not fam and not initial and not title, bool(fam) and not given and not initial and not title, head.rstrip()[-1:] in (".", "?", "!"),
            amp and after_amp in ("G", "I", "T", "F", "M"), amp and not after_amp, "@" in tail[:2] or tail[:1] in "._+" and tail[1:2].isalnum(),
            j + 1 < n and bool(nxt) and tok[j + 1][0][0].isupper(), prev_cap, nxt2 in FIRM or nxt2 in THING, tail[:1] in (",", ";", ")", "", "/"), tail[:2] in (": ", " -", " /"), head.endswith("- ") or head.endswith("-- "),
            low[start] in lex.given, tail.startswith(("'s", "’s")), nxt == "and",
        ]
        strong, weak = bool(_STRONG_END.search(t, max(0, a - 40), a)), bool(before) and before[-1] in _WEAK
        known = sum(bool(kinds[q]) for q in range(start, j + 1)) / len(words)
        return [*x, shape, strong, weak, known, any(low[q] in PLACE or low[q] in FIRM or low[q] in THING or low[q] in _OFFICE or low[q] in BEFORE_PLACE for q in range(start, j + 1)), nxt in _OFFICE or nxt2 in PLACE or nxt2 in _OFFICE, len(b_word := words[-1]), b_word.isupper()]

    def shapes(have: list) -> list:
        """Runs of capital words behind a title or a cue, in every length; those a list has found already are left out."""
        got, spans = [], {(a, b) for a, b, *_ in have}
        longest = {}
        for a, b, *_ in have:
            longest[a] = max(b, longest.get(a, 0))
        starts = [x[1] for x in tok]
        for title_at, _, run_at, _ in _shaped(t):
            title = title_at is not None
            start = bisect_left(starts, run_at)
            first = bisect_left(starts, title_at) if title else start
            if start >= n or starts[start] != run_at:
                continue
            j, capitals = start, 0
            while j < n and capitals < 5:
                w = tok[j][0]
                if low[j] in _BETWEEN and j > start and j + 1 < n and tok[j + 1][0][0].isupper() and gap(j, j + 1, ""):
                    j += 1
                    continue
                if not w[0].isupper() or low[j] in OPENERS or low[j] in _BRIEF_WORDS and len(w) == 2 and w.isupper():
                    break
                capitals += 1
                a, b = tok[first][1], tok[j][2]
                if (a, b) not in spans and b > longest.get(a, 0) and (len(w) > 1 or capitals > 1):
                    spans.add((a, b))
                    got.append((a, b, "name", features(first, start, j, title, any(len(tok[q][0]) == 1 for q in range(start, j + 1)), kinds[start] == "G", kinds[j] if j > start else "", False, True)))
                if j + 1 >= n or not (gap(j, j + 1, kinds[j]) or (len(w) == 1 and gap(j, j + 1, "I"))) or "\n" in t[tok[j][2] : tok[j + 1][1]]:
                    break
                j += 1
        return got

    while i < n:
        k = kinds[i]
        if not k:
            # An unknown family name set before a given one: Family, Given.
            if i + 1 < n and kinds[i + 1] in ("G", "I") and tok[i][0][0].isupper() and re.fullmatch(rf",{_S}+", t[tok[i][2] : tok[i + 1][1]]) and cap(i) and tok[i + 1][0][0].isupper() and low[i] not in CUE and not (i + 2 < n and kinds[i + 2] in ("F", "M") and gap(i + 1, i + 2, kinds[i + 1])):
                k = kinds[i] = "C"
            else:
                i += 1
                continue
        j, title, initial, given, fam, comma = i, False, False, False, "", False
        if kinds[j] == "T":
            title = True
            if j + 1 < n and gap(j, j + 1, "T"):
                j += 1
            else:
                i += 1
                continue
        start = j
        if kinds[j] in ("F", "M", "C"):
            fam = kinds[j]
            # Family, Given
            g = t[tok[j][2] : tok[j][2] + 1]
            if j + 1 < n and g.startswith(",") and re.fullmatch(rf",{_S}+", t[tok[j][2] : tok[j + 1][1]]) and kinds[j + 1] in ("G", "I", "T") and not (low[j + 1] == "p" and j + 2 < n and low[j + 2] in ("o", "obox")):
                comma = True
                j += 1
                if kinds[j] == "T" and j + 1 < n and gap(j, j + 1, "T"):
                    j += 1
                given, initial = kinds[j] == "G", kinds[j] == "I"
                if j + 1 < n and kinds[j + 1] == "I" and gap(j, j + 1, kinds[j]):
                    j += 1
            elif fam == "C":
                i += 1
                continue
            elif j + 1 < n and kinds[j + 1] == "G" and gap(j, j + 1, ""):
                given = True
                j += 1
        elif kinds[j] in "GI" and kinds[j]:
            given, initial = kinds[j] == "G", kinds[j] == "I"
            while j + 1 < n and kinds[j + 1] == "I" and gap(j, j + 1, kinds[j]) and j - start < 3:
                j += 1
                initial = True
            if j + 1 < n and gap(j, j + 1, kinds[j]):
                if kinds[j + 1] in ("F", "M"):
                    j += 1
                    fam = kinds[j]
                elif kinds[j] == "G" and not kinds[j + 1] and tok[j][0].islower() and tok[j + 1][0].islower() and (len(low[j + 1]) >= 6 and low[j + 1][-4:] in lex.tails or low[j + 1] in lex.brief - OPENERS - VERB - CUE):
                    j += 1
                    fam = "M"
                elif kinds[j + 1] == "G" and kinds[j] != "I" and tok[j + 1][0][0].isupper() and tok[j][0][0].isupper():
                    j += 1
                    fam = "G"
                elif "\n" not in t[tok[j][2] : tok[j + 1][1]] and cap(j + 1) and (given or title or initial) and not (kinds[j] == "I" and "." not in t[tok[j][2] : tok[j + 1][1]]):
                    j += 1
                    fam = "C"
        elif title and cap(j):
            fam = "C"
        else:
            i += 1
            continue
        if initial and not given and not fam:
            i += 1
            continue
        # A code is no name.
        if re.match(r"[-‑]?\d", t[tok[j][2] : tok[j][2] + 2]):
            i = j + 1
            continue
        # A unit, a compass point or an appendix before a new sentence is no initial.
        if kinds[i] == "I" and fam in ("C", "G") and ((i and low[i - 1] in _LETTERED) or t[max(0, tok[i][1] - 1) : tok[i][1]] in ("/", "-", "‑") or t[max(0, tok[i][1] - 2) : tok[i][1]].strip()[-1:].isdigit()):
            i += 1
            continue
        # "Dr. Given ... Family" where a second capital follows a listed family name is left to the features.
        a, b = tok[i][1], tok[j][2]
        words = [tok[x][0] for x in range(start, j + 1)]
        lower = all(w.islower() for w in words)
        if not lower and fam == "M" and not given and not title and not initial and words[-1].islower():
            i = j + 1
            continue
        if lower and not (given and fam):
            i = j + 1
            continue
        out.append((a, b, "name", features(i, start, j, title, initial, given, fam, comma, False)))
        i = j + 1
    return out + shapes(out)


def _shaped(t: str) -> Iterator[tuple[int | None, bool, int, int]]:
    """(start of the title or none, whether the cue is strong, start and end of the run) of capital words behind a title or a cue.

    Behind a weak cue the common places, firms and offices are no candidates.
    """
    for m in _RUN.finditer(t):
        at, end = m.span()
        before = _LAST.search(t, max(0, at - 24), at)
        lead, lead_at = (before[1].lower(), before.start(1)) if before else ("", at)
        while True:
            if lead in _TITLE_WORDS and "\n" not in t[lead_at:at]:
                yield lead_at, True, at, end
            elif lead in _LEADS and t[at - 2 : at - 1] not in (".", "!", "?"):
                strong = bool(_STRONG_END.search(t, max(0, at - 40), at))
                if strong or not _NO_NAME & set(_BARE.findall(t[at:end].lower())):
                    yield None, strong, at, end
            # The next word of the run, behind the one before.
            gap = t.find(" ", at, end)
            if gap < 0:
                break
            lead, lead_at, at = t[at:gap].rstrip(".").lower(), at, gap + 1


def _may_name(t: str, words: set[str], lex: Lexicon) -> bool:
    """A cheap test that people() can propose anything."""
    if not lex.known.isdisjoint(words) or not _TITLED.isdisjoint(words) or _INITIAL.search(t) or not t.isascii():
        return True
    if not lex.short.isdisjoint(words):
        return True
    if any(w[:4].lower() in lex.heads for w in _CAPITAL.findall(t)):
        return True
    return next(_shaped(t), None) is not None


def proposals(t: str, lex: Lexicon) -> list:
    """All candidate spans of a text: (start, end, type, features)."""
    out = []
    words = set(_BARE.findall(t.lower()))
    if "@" in t or ("at" in words and _SPELLED_AT.search(t)):
        out += emails(t)
    if _LONG_NUMBER.search(t):
        out += numbers(t)
    if not _ADDRESS_WORDS.isdisjoint(words):
        out += addresses(t)
    if _may_name(t, words, lex):
        out += people(t, lex)
    return out


_BARE = re.compile(r"[^\W\d_]+")
_NO_NAME = PLACE | FIRM | THING | BEFORE_PLACE | _OFFICE | OPENERS
_INITIAL = re.compile(rf"(?<![\w.])[A-Z]\.{_S}?(?:[A-Z]\.{_S}?)?[A-Z]")
_SPELLED_AT = re.compile(r"[\[(]\s*[aA][tT]\s*[\])]")
_CAPITAL = re.compile(r"[A-Z][^\W\d_]{5,}")
_TITLED = frozenset("mr mrs ms dr prof professor".split())
_ADDRESS_WORDS = frozenset(re.findall(r"[a-z]{2,}", STREETS)) | {"rue", "box", "rr", "rural", "r"}


_GIVES_WAY = {"email": 0, "address": 0, "phone": 1, "id_number": 1, "name": 2}


def choose(found: list[tuple[int, int, str, float]]) -> list[tuple[int, int, str, float]]:
    """Of overlapping spans the most probable; numbers give way to addresses and e-mails they touch, names to all of these."""
    kept: list[tuple[int, int, str, float]] = []  # in order, apart from each other
    for s in sorted(found, key=lambda s: (_GIVES_WAY[s[2]], -s[3], s[0] - s[1], s[0])):
        i = bisect_left(kept, s)
        if (i == 0 or kept[i - 1][1] <= s[0]) and (i == len(kept) or s[1] <= kept[i][0]):
            kept.insert(i, s)
    return kept


@dataclass
class Finder:
    """Lexicon and fitted trees; sent to the workers."""

    lex: Lexicon
    trees: dict[str, Boost]

    def spans(self, texts: list[str | None]) -> list[list[tuple[int, int, str, float]]]:
        """The mentions of each text, scored for the whole batch at once."""
        by: dict[str, tuple[list, list]] = {k: ([], []) for k in TYPES}
        for i, t in enumerate(texts):
            if t:
                for a, b, kind, x in proposals(t, self.lex):
                    by[kind][0].append((i, a, b))
                    by[kind][1].append(x)
        found: dict[int, list] = defaultdict(list)
        for kind, (where, xs) in by.items():
            if where and kind in self.trees:
                m = self.trees[kind]
                p = m.prob(np.array(xs, dtype=np.float32))
                for (i, a, b), q in zip(where, p):
                    if q >= m.threshold:
                        found[i].append((a, b, kind, float(q)))
        return [choose(found[i]) if i in found else [] for i in range(len(texts))]


# How many features of a name mark it as proposed by shape: the one after those of the lists.
_SHAPE_AT = -8


def fit(lex: Lexicon, sample: int = SAMPLE) -> Finder:
    """Trees fitted on composed texts with marked mentions; a fifth of the sample, of held-out sentences and origins, calibrates."""
    from reviewloom.llm.training import composed

    xs: dict[str, list] = {k: [] for k in TYPES}
    ys: dict[str, list] = {k: [] for k in TYPES}
    hs: dict[str, list] = {k: [] for k in TYPES}
    for part, size in (("train", sample - sample // 5), ("held", sample // 5)):
        for text, marks in composed(lex, size, part=part):
            for a, b, kind, x in proposals(text, lex):
                # A span by shape must be the name, one by list may miss a part.
                least = 0.85 if kind == "name" and x[_SHAPE_AT] else 0.6 if kind == "name" else 0.0
                share = lambda s, e: min(b, e) - max(a, s) >= least * ((max(b, e) - min(a, s)) if least > 0.6 else (e - s))  # noqa: B023, E731
                xs[kind].append(x)
                ys[kind].append(float(any(k == kind and a < e and s < b and share(s, e) for s, e, k in marks)))
                hs[kind].append(part == "held")
    trees = {}
    for k in TYPES:
        x, y, held = np.array(xs[k], dtype=np.float32), np.array(ys[k]), np.array(hs[k])
        if len(y) and 0 < y.sum() < len(y):
            both = lambda part: len(part) and 0 < part.sum() < len(part)
            # Where the held-out sentences have candidates of one kind only, every fifth candidate is held out.
            trees[k] = Boost().fit(x, y, held if both(y[held]) and both(y[~held]) else None)
    return Finder(lex, trees)


_FOUND = "rec_id bigint, field_name string, pii_type string, ordinal int, span_start int, span_end int, score double"
_FITTED: dict[tuple, Finder] = {}


def finder(rows: DataFrame, sample: int = SAMPLE) -> Finder:
    """The model for these rows' names; fitted once for each lexicon in a session."""
    lex = lexicon(rows)
    key = (hash(lex.given), hash(lex.family), hash(lex.brief), sample)
    if key not in _FITTED:
        _FITTED.clear()
        _FITTED[key] = fit(lex, sample)
    return _FITTED[key]


def save(use: Finder, spark: SparkSession, path: str) -> None:
    """Write a fitted model to shared storage."""
    spark.createDataFrame([(pickle.dumps(use),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> Finder:
    """A model that `save` wrote; only from a folder that is trusted, as it is a pickle."""
    return pickle.loads(spark.read.parquet(path).first().model)


def mentions(rows: DataFrame, key: str = "rec_id", fields: tuple[str, ...] = ("comment_text", "response_text"), use: Finder | None = None) -> DataFrame:
    """One row per mention; ordinal counts the mentions of a type in a field by position."""
    use = use or finder(rows)
    shared = rows.sparkSession.sparkContext.broadcast(use)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = shared.value
        for pdf in batches:
            out = []
            ids = [None if x is None else int(x) for x in pdf[key]]
            for c in fields:
                for rec, spans in zip(ids, f.spans(pdf[c].tolist())):
                    if spans:
                        seen: dict[str, int] = {}
                        for a, b, kind, q in spans:
                            seen[kind] = seen.get(kind, 0) + 1
                            out.append((rec, c, kind, seen[kind], a, b, q))
            found = pd.DataFrame(out, columns=[c.split()[0] for c in _FOUND.split(", ")])
            found["rec_id"] = pd.array([r[0] for r in out], dtype="Int64")
            yield found

    # The key travels as text: a null would turn a batch of numbers into floats.
    return rows.select(F.col(key).cast("string"), *fields).mapInPandas(run, _FOUND)


def redact(rows: DataFrame, fields: tuple[str, ...] = ("comment_text", "response_text"), use: Finder | None = None) -> DataFrame:
    """The rows with each mention in the fields replaced by a placeholder such as [EMAIL]."""
    use = use or finder(rows)
    shared = rows.sparkSession.sparkContext.broadcast(use)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = shared.value
        for s in batches:
            texts = s.tolist()
            out = []
            for t, spans in zip(texts, f.spans(texts)):
                for a, b, kind, _ in reversed(spans):
                    t = f"{t[:a]}[{kind.upper()}]{t[b:]}"
                out.append(t)
            yield pd.Series(out, dtype=object)

    return rows.withColumns({c: clean(c) for c in fields})

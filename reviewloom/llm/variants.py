"""Variant spellings of one body or person, linked by a noisy channel.

Different values are counted, brought to a plain form and ranked by frequency.
Every form is a possible canonical form for rarer ones; candidates share a key:
a piece of the run-together name (a name with at most two slips keeps one of
three pieces, up to a shift; a short one with one slip, one of two), its initials or acronym, the first letters of its
words in any order, all or but one, or for persons a word with one letter left
out, or two where the channel accepts two slips. Not met are bodies whose words
are turned or cut short and slip in a first letter besides, if they have two
words or slip so in two. A key that more than `HOT` forms share is narrowed by
pieces of what is left of the name, which any two names within two slips share
as well, so no link is lost by it.

The posterior of a candidate is the logarithm of its frequency less the
channel's price of the variant; a form's best candidate is its parent. Where
letters changed, the form's own name competes: written for the candidate, the
form should have a small part of both frequencies (beta with the mean and
strength that the sure links show, see `Slips`), as a name of its own any part
(uniform) at the cost `NEW`. So two names of like and large frequency stay
apart, while a rare one attaches. Initials, nicknames, titles, order, spacing
and shortened words are no changed letters. Following the parents to the end
gives a root; every form is then priced against its root, and one that no single
way of writing explains, or whose own name is likelier, goes to the best root
that explains it or stands for itself. Where a list of known bodies is given,
its entries are canonical from the start and their other names belong to them.

Only counts per different value are shuffled after the first aggregate, and
candidate pairs come from equal keys within a scope, never from all pairs. The
output lists pairs of one entity, as asked; it is quadratic in the spellings
of an entity, not in its rows. `link` itself gives each value with its entity.

Empty cells (null, blank, placeholder) are no names; a value that reads as no
word stays alone; ties go to the form that sorts first. An empty table gives an
empty result. Other columns of the table are not read.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations
from math import lgamma, log

import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reviewloom.common import cut, is_empty
from reviewloom.llm import names as N

SLIP_PRICE = 3.0
# Family names up to this length meet by letters left out, longer ones by pieces; lengths up to two below have both.
LEFT_OUT = 18
# The cost of a new name, a logarithm: how much likelier a form with changed letters is a slip before frequencies are seen.
NEW = 3.0
HOT = 500


@dataclass(frozen=True)
class Slips:
    """What part of both frequencies a slip has: a beta of this mean and strength.

    Estimated from links that are sure (one candidate many times as frequent);
    the strength is bounded, so that no estimate makes the test sharper than that.
    """

    mean: float = 0.1
    strength: float = 12.0
    # Bounds of the estimate, the frequency of a sure link's canonical form, and how many links an estimate needs.
    most_strength = 15.0
    sure = 20
    least = 30

    @classmethod
    def of(cls, n: int, mean: float | None, var: float | None) -> Slips:
        """From the moments of the parts that slips have among sure links."""
        if n < cls.least or not mean or not var:
            return cls()
        mean = min(max(mean, 0.02), 0.2)
        return cls(mean, min(max(mean * (1 - mean) / var - 1, 5.0), cls.most_strength))

    def is_slip(self, n: int, of: int, new: float = NEW) -> bool:
        """A form seen n times is likelier a slip of one seen `of` times than a name of its own."""
        a, b = self.mean * self.strength, (1 - self.mean) * self.strength
        beta = lambda x, y: lgamma(x) + lgamma(y) - lgamma(x + y)
        slip = lgamma(n + of + 1) - lgamma(n + 1) - lgamma(of + 1) + beta(n + a, of + b) - beta(a, b)
        return slip + new > -log(n + of + 1)


def _plain(kind: str, s: str) -> str:
    if kind == "org":
        return " ".join(N.org_words(s)) or s
    return "|".join(f"{g}/{f}" for g, f, _ in N.person(s)) or s


def _pieces(s: str, probe: bool, pieces: int = 0) -> list[str]:
    """Keys by which strings with at most two slips meet: equal pieces at near positions.

    Two swaps across the ends of pieces spoil up to four, so five `pieces` meet always.
    """
    out = set()
    for n in range(len(s) - 2, len(s) + 3) if probe else (len(s),):
        kk = pieces or (3 if n >= 9 else 2)
        if n < 4:
            continue
        for i in range(kk):
            a, b = i * n // kk, (i + 1) * n // kk
            for shift in range(-2, 3) if probe else (0,):
                if 0 <= a + shift and b + shift <= len(s):
                    out.add(f"{i}:{n}:{s[a + shift:b + shift]}")
    return sorted(out)


def _narrow(plain: str, key: str, probe: bool) -> list[str]:
    """A hot key of a body with the pieces of the rest of its name; other keys as they are.

    Two names within two slips that share a piece have all slips in the rest, of
    which one of five pieces is equal then.
    """
    i, n, piece = (*key.split(":", 2), "", "")[:3] if key[:1].isdigit() else ("", "", "")
    if not piece or int(n) - len(piece) < 8:
        return [key]
    out = set()
    w = plain.split()
    for s in {"".join(w), "".join(N.big(w))}:
        at = s.find(piece)
        while at >= 0:
            # At its place, up to the shifts of _pieces.
            if abs(at - int(i) * int(n) // (3 if int(n) >= 9 else 2)) <= 2 and (probe or len(s) == int(n)):
                out.update(f"{key}/{k}" for k in _pieces(s[:at] + s[at + len(piece) :], probe, 5))
            at = s.find(piece, at + 1)
    return sorted(out)


def _keys(kind: str, plain: str, probe: bool, codes: str) -> list[str]:
    """The keys of a form; a pair meets where a probe key equals an index key."""
    out: set[str] = set()
    if kind == "org":
        w = plain.split()
        b = N.big(w)
        for s in {"".join(w), "".join(b)}:
            out.update(_pieces(s, probe))
            if len(s) < 6:
                out.add(f"w:{s}")
        if len(b) > 1:
            # Words cut short or turned round.
            out.add("i:" + "|".join(sorted(x[:3] for x in b)))
            first = sorted(x[0] for x in b)
            out.add(f"b:{len(b)}:{''.join(first)}")
            if len(b) > 2:
                out.update(f"c:{len(b)}:{''.join(first[:i] + first[i + 1:])}" for i in range(len(b)))
        # Initials meet full names only, in either order of frequency.
        full, short = ("f:", "s:") if probe else ("s:", "f:")
        if len(w) > 1:
            out.update(full + x for x in N.initials(w))
            out.update(short + x for x in (w[0], w[-1]) if len(x) >= 2)
        elif len(plain) >= 2:
            out.add(short + plain)
        out.update(full + x for x in codes.split())
        return sorted(out)
    for reading in plain.split("|"):
        given, _, family = reading.partition("/")
        for f in {family, given[:1] + family if given else family}:
            out.add(f)
            out.update(f[:i] + f[i + 1 :] for i in range(len(f)) if len(f) > 3)
        # Family names of seven letters and more may have two slips, but begin alike then.
        if 7 <= len(family) <= LEFT_OUT:
            out.update(family[:i] + family[i + 1 : j] + family[j + 1 :] for i, j in combinations(range(1, len(family)), 2))
        if len(family) > LEFT_OUT - 2:
            out.update(_pieces(family, probe, 5))
    return sorted(out)


def link(values: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Canonical form of every value.

    values: field_name, name_scope, kind ('org' or 'person'), value, n.
    known: field_name, name_scope, canonical, name, code — other names and short
    codes of listed bodies. Returns values with `entity`.
    """

    @F.pandas_udf("string")
    def plain(kind: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([_plain(k, x) for k, x in zip(kind, s)], dtype=object)

    @F.pandas_udf("array<string>")
    def index_keys(kind: pd.Series, s: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([_keys(k, x, False, c) for k, x, c in zip(kind, s, codes)], dtype=object)

    @F.pandas_udf("array<string>")
    def probe_keys(kind: pd.Series, s: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([_keys(k, x, True, c) for k, x, c in zip(kind, s, codes)], dtype=object)

    @F.pandas_udf("array<string>")
    def narrowed(s: pd.Series, keys: pd.Series, probe: pd.Series) -> pd.Series:
        return pd.Series([_narrow(x, k, bool(p)) for x, k, p in zip(s, keys, probe)], dtype=object)

    @F.pandas_udf("price double, changed boolean")
    def way(kind: pd.Series, v: pd.Series, c: pd.Series, codes: pd.Series) -> pd.DataFrame:
        out = []
        for k, a, b, cs in zip(kind, v, c, codes):
            if k == "org":
                x, y = a.split(), b.split()
                both = [p for p in (N.org_way(x, y, frozenset(cs.split())), N.org_way(y, x)) if p is not None]
                out.append(min(both) if both else (None, None))
            else:
                x, y = ([(g, f, 0.3 * (i > 0)) for i, (g, _, f) in enumerate(r.partition("/") for r in t.split("|"))] for t in (a, b))
                out.append(N.person_way(x, y) or (None, None))
        return pd.DataFrame(out, columns=["price", "changed"]).astype({"price": "float64", "changed": "boolean"})

    key = ["field_name", "name_scope", "kind", "form"]
    x = cut(values.withColumn("form", plain("kind", "value")))
    forms = x.groupBy(*key).agg(F.sum("n").alias("n")).withColumns({"listed": F.lit(False), "codes": F.lit(""), "parent0": F.lit(None).cast("string")})
    if known is not None:
        k = known.withColumn("kind", F.lit("org")).withColumns({"form": plain("kind", "name"), "root": plain("kind", "canonical")})
        k = k.select(*key, F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("listed"), F.lower(F.coalesce("code", F.lit(""))).alias("codes"), F.when(F.col("form") != F.col("root"), F.col("root")).alias("parent0"))
        forms = forms.unionByName(k).groupBy(*key).agg(F.sum("n").alias("n"), F.max("listed").alias("listed"), F.max("codes").alias("codes"), F.max("parent0").alias("parent0"))
    forms = cut(forms)

    scope = key[:3]
    idx = forms.select(*scope, F.col("form").alias("c"), F.col("n").alias("cn"), F.col("listed").alias("cl"), F.col("codes").alias("cc"), F.explode(index_keys("kind", "form", "codes")).alias("key"))
    prb = forms.where(~F.col("listed") & F.col("parent0").isNull()).select(*scope, "form", "n", F.explode(probe_keys("kind", "form", "codes")).alias("key"))
    hot = cut(idx.where("kind = 'org'").groupBy(*scope, "key").agg(F.count("*").alias("sharing")).where(F.col("sharing") > HOT).drop("sharing"))
    if not hot.isEmpty():
        split = lambda d, name, probe: d.join(hot, [*scope, "key"], "left_anti").unionByName(
            d.join(hot, [*scope, "key"], "left_semi").withColumn("key", F.explode(narrowed(name, "key", F.lit(probe)))).select(*d.columns)
        )
        idx, prb = split(idx, "c", False), split(prb, "form", True)
    better = F.col("cl") | (F.col("cn") > F.col("n")) | ((F.col("cn") == F.col("n")) & (F.col("c") < F.col("form")))
    pairs = prb.join(idx, [*scope, "key"]).where((F.col("form") != F.col("c")) & better).select(*scope, "form", "n", "c", "cn", "cl", "cc").distinct()
    # Written before the filter, which would ask for every price a second time.
    pairs = cut(pairs.withColumn("way", way("kind", "form", "c", "cc")).select("*", "way.price", "way.changed").drop("way")).where("price is not null")

    # What slips look like: changed letters towards a form many times as frequent.
    part = F.col("n") / (F.col("n") + F.col("cn"))
    slips = Slips.of(*pairs.where(F.col("changed") & (F.col("cn") >= Slips.sure) & (F.col("n") * 2 <= F.col("cn"))).groupBy(*scope, "form").agg(F.min_by(part, "price").alias("part")).agg(F.count("part"), F.avg("part"), F.var_pop("part")).first())

    @F.pandas_udf("boolean")
    def is_slip(n: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([slips.is_slip(a, b) for a, b in zip(n, of)], dtype=bool)

    def attach(p: DataFrame) -> DataFrame:
        """The best candidate of each form in p, unless the form's own name is likelier; listed names are no guess."""
        p = p.where(~F.col("changed") | F.col("cl") | is_slip("n", "cn"))
        score = F.log(F.col("cn") + 1.0) - SLIP_PRICE * F.col("price")
        return p.groupBy(*scope, "form").agg(F.min_by("c", F.struct(-score, "c")).alias("parent"))

    up = cut(forms.join(attach(pairs), [*scope, "form"], "left").select(*scope, "form", "n", "listed", "codes", F.coalesce("parent", "form").alias("root")))
    # Follow the links; a link always leads to a more frequent or listed form, so this ends.
    while True:
        top = up.select(*scope, F.col("form").alias("root"), F.col("root").alias("next"))
        new = cut(up.join(top, [*scope, "root"], "left").withColumn("moved", F.coalesce("next", "root") != F.col("root")).withColumn("root", F.coalesce("next", "root")).drop("next"))
        up = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    # Each form against its root; a listed body's other names are roots as well, until the end.
    roots = up.where(F.col("form") == F.col("root")).select(*scope, F.col("form").alias("c"), F.col("n").alias("cn"), F.col("listed").alias("cl"), F.col("codes").alias("cc"))
    loose = up.where(F.col("form") != F.col("root"))
    own = loose.select(*scope, "form", "n", F.col("root").alias("c")).join(roots, [*scope, "c"])
    own = cut(own.withColumn("way", way("kind", "form", "c", "cc")).select("*", "way.price", "way.changed").drop("way"))
    own_ok = attach(own.where("price is not null"))
    lost = own.join(own_ok.select(*scope, "form"), [*scope, "form"], "left_anti").select(*scope, "form")
    second = attach(pairs.join(lost, [*scope, "form"], "left_semi").join(roots.select(*scope, "c"), [*scope, "c"], "left_semi"))
    fixed = lost.join(second, [*scope, "form"], "left").select(*scope, "form", F.coalesce("parent", "form").alias("again"))
    up = up.join(fixed, [*scope, "form"], "left").select(*scope, "form", F.coalesce("again", "root").alias("root"))
    other = forms.where("parent0 is not null").select(*scope, F.col("form").alias("root"), "parent0")
    up = up.join(other, [*scope, "root"], "left").select(*scope, "form", F.coalesce("parent0", "root").alias("root"))
    return x.join(up, key).select("field_name", "name_scope", "value", "n", F.col("root").alias("entity"))


def pairs_of(linked: DataFrame) -> DataFrame:
    """(field_name, name_scope, name_a, name_b): different values of one entity."""
    k = ["field_name", "name_scope", "entity"]
    a, b = linked.select(*k, F.col("value").alias("name_a")), linked.select(*k, F.col("value").alias("name_b"))
    return a.join(b, k).where("name_a < name_b").select("field_name", "name_scope", "name_a", "name_b")


def review_values(rows: DataFrame) -> DataFrame:
    """The agencies of all rows and the authors of each project, counted."""
    cell = lambda field, scope, kind, c: F.struct(F.lit(field).alias("field_name"), scope.alias("name_scope"), F.lit(kind).alias("kind"), F.col(c).alias("value"))
    cells = F.array(cell("agency", F.lit("all"), "org", "agency"), cell("author", F.coalesce("project", F.lit("")), "person", "author"))
    x = rows.select(F.explode(cells).alias("c")).select("c.*").where(~is_empty(F.col("value")))
    return x.groupBy("field_name", "name_scope", "kind", "value").agg(F.count("*").alias("n"))


def known_agencies(canonical: DataFrame) -> DataFrame:
    """Names and codes of the listed agencies, one row per name."""
    c = canonical.where("field_name = 'agency' and canonical_value is not null")
    other = F.split(F.coalesce("also_known", F.lit("")), r"\s*;\s*")
    named = F.explode(F.array_distinct(F.filter(F.concat(F.array("canonical_value"), other), lambda s: F.trim(s) != "")))
    return c.select("field_name", F.lit("all").alias("name_scope"), F.col("canonical_value").alias("canonical"), named.alias("name"), F.col("short_code").alias("code"))

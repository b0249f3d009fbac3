"""Free-entered values mapped to a canonical list by a set-similarity join.

Different values and the list's names become sets of letter pairs. The list is
widened by rule: initials, each word, words cut to their first letters, and the
letters that a short word keeps when it is cut down; a value other than a body's
name is met by each of its words as well, so `SIMILARITY` need not be low. Pairs of letters are ordered by how rare they are over all
sets; two sets of Jaccard similarity t or more share a member among the rare
first ones of both, so only those prefixes are joined, thinned by length and
position, and the similarity is then verified exactly. For each value the most
similar entry is kept of those that a way of writing explains (the exact check
that follows the join); a value without any is reported as `UNMATCHED`.

Empty cells are no values. A value without letters or digits is UNMATCHED. A
tie between different entries is UNMATCHED when both are mere cut-downs, else
the entry of the smaller item_id stays. Repeated list entries count once. An
empty list leaves every value UNMATCHED; an empty table gives an empty result.
Other columns of both tables are not read.
"""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from reviewloom.common import cut, is_empty
from reviewloom.llm import names as N

SIMILARITY = 0.5
UNMATCHED = "UNMATCHED"


def _forms(name: str, code: str | None, organisation: bool) -> list[str]:
    """Run-together strings under which the list can be met."""
    w = N.org_words(name)
    out = {"".join(w), "".join(N.big(w))}
    if len(w) > 1:
        out |= N.initials(w)
    if code:
        out.add(N.fold(code))
    if not organisation:
        out.update(w)
        out.update("".join(x[:n] for x in w) for n in (3, 4))
        for x in {*w, "".join(w)}:
            if len(x) >= 4:
                out.update(x[0] + "".join(t) for n in (1, 2) for t in combinations(x[1:], n))
    else:
        # Initials beside a word of the name, and words cut to their first letters.
        for k in ({N.fold(code)} if code else set()) | N.initials(w):
            out.update(y for x in N.big(w) for y in (k + x, x + k))
        out.update("".join(x[:n] for x in N.big(w)) for n in (3, 4))
    return sorted(x for x in out if len(x) >= 2)


def _probes(raw: str, organisation: bool) -> list[str]:
    """Run-together strings under which a value looks for the list: itself, and its words unless it names a body."""
    w = N.org_words(raw, notes=not organisation)
    return sorted(x for x in {"".join(w), *(() if organisation else w)} if x)


def explain(raw: str, name: str, code: str | None, organisation: bool) -> float | None:
    """Price of writing the list's name as raw, or None."""
    v, c = N.org_words(raw, notes=not organisation), N.org_words(name)
    if not v or not c:
        return None
    price = N.org_cost(v, c, frozenset({N.fold(code)}) if code else frozenset())
    if organisation or (price is not None and price <= 1.5):
        return price
    ways = [] if price is None else [price]
    bv, bc = N.big(v), N.big(c)
    one, whole = "".join(v), "".join(c)
    k, extra, missing = N.align(bv, bc)
    matched = len(bc) - missing
    if matched:
        # The whole name among other words, or a telling part of it.
        if missing == 0 and extra <= 3 and k <= 1.0 * matched:
            ways.append(1.0 + k + 0.5 * extra)
        elif extra == 0 and k <= 1.0 and len(max(bv, key=len)) >= 4:
            ways.append(1.5 + k + 0.5 * missing)
    if len(v) <= 2 and 2 <= len(one) <= 4 and one[0] == whole[0] and len(whole) > len(one):
        if whole.startswith(one):
            ways.append(1.6)
        elif N.within(one, whole):
            ways.append(2.5)
    return min(ways) if ways else None


def grams(c: Column) -> Column:
    """The set of letter pairs of a run-together string, its ends included."""
    s = F.concat(F.lit("^"), c, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substring(s, i, F.lit(2))))


def set_join(probe: DataFrame, index: DataFrame, scope: str, t: float = SIMILARITY) -> DataFrame:
    """(scope, p, r, similarity): strings p of probe and r of index with Jaccard >= t.

    Both have a scope column and a string column (`p`, `r`) of different values.
    """
    p = probe.select(scope, F.col("p").alias("s"), F.lit(True).alias("is_probe")).distinct()
    r = index.select(scope, F.col("r").alias("s"), F.lit(False).alias("is_probe")).distinct()
    sets = cut(p.unionByName(r).withColumn("g", grams(F.col("s"))))
    rarity = sets.select(scope, F.explode("g").alias("gram")).groupBy(scope, "gram").agg(F.count("*").alias("df"))
    ranked = sets.select(scope, "s", "is_probe", F.size("g").alias("n"), F.explode("g").alias("gram")).join(rarity, [scope, "gram"])
    w = W.partitionBy(scope, "is_probe", "s").orderBy("df", "gram")
    prefix = ranked.withColumn("at", F.row_number().over(w)).where(F.col("at") <= F.col("n") - F.ceil(F.col("n") * t) + 1)
    a = prefix.where("is_probe").select(scope, "gram", F.col("s").alias("p"), F.col("n").alias("pn"), F.col("at").alias("pa"))
    b = prefix.where("not is_probe").select(scope, "gram", F.col("s").alias("r"), F.col("n").alias("rn"), F.col("at").alias("ra"))
    need = F.ceil(t / (1 + t) * (F.col("pn") + F.col("rn")))
    x = a.join(b, [scope, "gram"]).where((F.col("rn") >= t * F.col("pn")) & (F.col("pn") >= t * F.col("rn")))
    # The first shared member bounds the overlap by what is left behind it.
    x = x.groupBy(scope, "p", "r", "pn", "rn").agg(F.min("pa").alias("pa"), F.min("ra").alias("ra"))
    x = x.where(F.least(F.col("pn") - F.col("pa"), F.col("rn") - F.col("ra")) + 1 >= need)
    shared = F.size(F.array_intersect(grams(F.col("p")), grams(F.col("r"))))
    x = x.withColumn("similarity", shared / (F.col("pn") + F.col("rn") - shared))
    return x.where(F.col("similarity") >= t).select(scope, "p", "r", "similarity")


def match(values: DataFrame, canonical: DataFrame, organisations: tuple[str, ...] = ("agency",), t: float = SIMILARITY) -> DataFrame:
    """(field_name, raw_value, canonical_value, similarity) for each row of values (field_name, raw_value)."""

    @F.pandas_udf("array<string>")
    def plain(field: pd.Series, s: pd.Series) -> pd.Series:
        return pd.Series([_probes(x, f in organisations) for f, x in zip(field, s)], dtype=object)

    @F.pandas_udf("array<string>")
    def forms(field: pd.Series, name: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([_forms(n, c, f in organisations) for f, n, c in zip(field, name, code)], dtype=object)

    @F.pandas_udf("double")
    def price(field: pd.Series, raw: pd.Series, name: pd.Series, code: pd.Series) -> pd.Series:
        return pd.Series([explain(a, b, c, f in organisations) for f, a, b, c in zip(field, raw, name, code)], dtype="float64")

    other = F.split(F.coalesce("also_known", F.lit("")), r"\s*;\s*")
    entries = canonical.where("field_name is not null and canonical_value is not null").select("field_name", "item_id", "canonical_value", "short_code", F.explode(F.array_distinct(F.filter(F.concat(F.array("canonical_value"), other), lambda s: F.trim(s) != ""))).alias("name"))
    index = cut(entries.withColumn("r", F.explode(forms("field_name", "name", "short_code"))))
    raw = cut(values.withColumn("ps", plain("field_name", "raw_value")))
    probes = raw.select("field_name", "raw_value", F.explode("ps").alias("p"))
    near = set_join(probes.select("field_name", "p"), index.select("field_name", "r"), "field_name", t)
    # A value meets a name of the list under its most similar form.
    hits = near.join(index, ["field_name", "r"]).groupBy("field_name", "p", "item_id", "canonical_value", "short_code", "name").agg(F.max("similarity").alias("similarity"))
    hits = probes.join(hits, ["field_name", "p"]).groupBy("field_name", "raw_value", "item_id", "canonical_value", "short_code", "name").agg(F.max("similarity").alias("similarity")).withColumn("price", price("field_name", "raw_value", "name", "short_code")).where("price is not null")
    per = hits.groupBy("field_name", "raw_value", "item_id", "canonical_value").agg(F.min("price").alias("price"), F.max("similarity").alias("similarity"))
    w = W.partitionBy("field_name", "raw_value").orderBy(F.desc("similarity"), "price", "item_id")
    per = per.withColumns({"place": F.row_number().over(w), "next": F.lead("price").over(w), "next_sim": F.lead("similarity").over(w)}).where("place = 1")
    vague = (F.col("price") >= 1.5) & (F.col("next") == F.col("price")) & (F.col("next_sim") == F.col("similarity"))
    best = per.where(~F.coalesce(vague, F.lit(False))).select("field_name", "raw_value", "canonical_value", "similarity")
    return raw.drop("ps").join(best, ["field_name", "raw_value"], "left").withColumn("canonical_value", F.coalesce("canonical_value", F.lit(UNMATCHED)))


def review_values(rows: DataFrame, fields=("agency", "status", "comment_type")) -> DataFrame:
    """Each different filled value of the fields; partial aggregation before the shuffle."""
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("raw_value")) for f in fields])
    return rows.select(F.explode(cells).alias("c")).select("c.*").where(~is_empty(F.col("raw_value"))).distinct()

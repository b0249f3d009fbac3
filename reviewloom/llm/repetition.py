"""Repetition inside one document, with verdicts on the hosts that produce it.

Each text is turned into words (letter case, punctuation and spacing aside; any
number reads as one `0`). A run of `RUN` words that began earlier in the same
text marks its words as repeated; the repeated share is their part of all
words. That is the exact check, and it is not made for every document:

1. Cheap rules measure each document: lines, paragraphs and word triples that
   occurred before. A measure at its limit is a failure.
2. Failures are added up by host (project and source); the failure rate is shrunk
   towards the corpus by an empirical beta prior, and a host whose shrunk rate
   is at least `BAD` times the corpus rate is bad.
3. Host verdicts join back to the documents: every document that failed a rule
   and every document of a bad host gets the exact check.

The limit on word triples is the least that a document with a repeated share of
`SHARE` can have: a run of six brings four triples that occurred before, and
runs that touch bring no fewer a word. So no document that reaches `SHARE` passes
the rules, whatever its host; the verdicts decide how much is checked besides.

Null and empty texts have no words and a share of 0; texts shorter than a run
repeat nothing. Whole texts are read. Equal documents are judged each for
itself. A null project or source forms a host of its own. Other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewloom.common import cut, maybe_broadcast

RUN = 6
SHARE = 0.3
SHORT = 3
BAD = 1.5
# Limits of the document rules; a measure at its limit fails.
RULES = {"line_share": 0.3, "paragraph_share": 0.3, "triple_share": SHARE * (RUN + 1 - SHORT) / RUN}

_NUMBER = re.compile(r"\d+(?:[.,:/\-]\d+)*")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """Words for comparison."""
    return _WORD.findall(_NUMBER.sub("0", text.lower()))


def repeated_mask(words: list[str], run: int = RUN) -> np.ndarray:
    """True for words inside a run of `run` words that started earlier too."""
    n = len(words)
    mask = np.zeros(n, dtype=bool)
    if n <= run:
        return mask
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words), dtype=np.uint64, count=n)
    m = n - run + 1
    # A 64-bit rolling key; words are numbered, so equal keys mean equal runs but for a 2^-64 chance.
    with np.errstate(over="ignore"):
        key = np.zeros(m, dtype=np.uint64)
        for k in range(run):
            key = (key ^ (code[k : k + m] * _MIX)) * np.uint64(0xFF51AFD7ED558CCD)
            key ^= key >> np.uint64(32)
    _, first, back = np.unique(key, return_index=True, return_inverse=True)
    again = np.flatnonzero(first[back] < np.arange(m))
    if len(again):
        edge = np.zeros(n + 1, dtype=np.int32)
        np.add.at(edge, again, 1)
        np.add.at(edge, again + run, -1)
        mask = np.cumsum(edge[:-1]) > 0
    return mask


def _again(parts: list[str]) -> float:
    """Share of characters in parts equal to an earlier one."""
    parts = [p for p in (x.strip() for x in parts) if p]
    if len(parts) < 2:
        return 0.0
    seen, total, twice = set(), 0, 0
    for p in parts:
        total += len(p)
        if p in seen:
            twice += len(p)
        seen.add(p)
    return twice / total


def triple_share(words: list[str]) -> float:
    """Share of words that begin a run of three which began earlier too."""
    n = len(words)
    return (n - 2 - len(set(zip(words, words[1:], words[2:])))) / n if n > SHORT else 0.0


def rules(text: str | None) -> tuple[int, float, float, float]:
    """(words, share of repeated lines, of repeated paragraphs, of repeated word triples)."""
    if not text:
        return 0, 0.0, 0.0, 0.0
    words = words_of(text)
    return len(words), _again(text.split("\n")), _again(text.split("\n\n")), triple_share(words)


def fails(measured: tuple[int, float, float, float]) -> bool:
    """Some rule's measure is at its limit; 1e-9 stands for rounding."""
    return any(m >= limit - 1e-9 for m, limit in zip(measured[1:], RULES.values()))


def exact(text: str | None) -> int:
    """The exact check: how many words of the text are repeated."""
    return int(repeated_mask(words_of(text)).sum()) if text else 0


def _host() -> Column:
    return F.concat_ws("/", F.coalesce(F.col("project"), F.lit("?")), F.coalesce(F.col("source"), F.lit("?"))).alias("host")


_MEASURES = "n_words int, line_share double, paragraph_share double, triple_share double, n_repeated int"
_NAMES = [c.split()[0] for c in _MEASURES.split(", ")]


def measures(docs: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, host, the measures of each text and its failed rules; one pass in Arrow batches.

    n_repeated is filled where a rule failed, as the words are at hand, or for `every` document.
    """

    @F.pandas_udf(_MEASURES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            rows = [(*(m := rules(t)), exact(t) if every or fails(m) else None) for t in s]
            out = pd.DataFrame(rows, columns=_NAMES)
            out["n_repeated"] = pd.array([r[-1] for r in rows], dtype="Int32")
            yield out

    failed = F.filter(F.array(*[F.when(F.col(k) >= v - 1e-9, F.lit(k)) for k, v in RULES.items()]), lambda r: r.isNotNull())
    return docs.select("doc_id", _host(), run("text").alias("m")).select("doc_id", "host", "m.*").withColumn("failed_rules", failed)


def hosts(measured: DataFrame) -> DataFrame:
    """(host, host_rate, host_bad): shrunk failure rate and verdict of each host.

    The beta prior is fitted by moments to the hosts' rates, weighted by their size.
    """
    host = measured.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.size("failed_rules") > 0).alias("k"))
    p = F.col("k") / F.col("n")
    total = host.agg((F.sum("k") / F.sum("n")).alias("mean"), F.sum("n").alias("n_all"), F.sum(p * p * F.col("n")).alias("m2"))
    total = total.withColumn("var", F.greatest(F.try_divide("m2", "n_all") - F.col("mean") ** 2, F.lit(1e-9)))
    # Beta(a, b) with the same mean and variance; its strength is kept positive.
    total = total.withColumn("strength", F.greatest(F.col("mean") * (1 - F.col("mean")) / F.col("var") - 1, F.lit(1.0))).select("mean", "strength")
    rate = (F.col("k") + F.col("strength") * F.col("mean")) / (F.col("n") + F.col("strength"))
    bad = (F.col("mean") > 0) & (rate >= BAD * F.col("mean") - 1e-9)
    return host.crossJoin(F.broadcast(total)).select("host", rate.alias("host_rate"), bad.alias("host_bad"))  # one row


def judged(docs: DataFrame) -> DataFrame:
    """Every document with its measures, exact share, failed rules, its host's shrunk rate and verdict, and whether these send it to the exact check."""
    m = cut(measures(docs, every=True))
    m = m.withColumn("repeated_share", F.when(F.col("n_words") > 0, F.col("n_repeated") / F.col("n_words")).otherwise(0.0))
    x = m.join(maybe_broadcast(hosts(m)), "host")
    return x.withColumn("checked", (F.size("failed_rules") > 0) | F.col("host_bad"))


def checked(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_repeated) of the documents whose rules or whose host's verdict asked for the exact check.

    Texts are read once for the rules, and once more for bad hosts only; nothing
    but host names and numbers is shuffled.
    """
    m = cut(measures(docs))
    bad = cut(hosts(m).where("host_bad").select("host"))
    failed = m.where("n_repeated is not null").select("doc_id", "n_words", "n_repeated")

    def unfailed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # What failed a rule has its exact check already.
            rows = [(k, m[0], exact(t)) for k, t in zip(pdf.doc_id, pdf.text) if not fails(m := rules(t))]
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_repeated"])
            out["doc_id"] = pd.array([None if k is None else int(k) for k, *_ in rows], dtype="Int64")
            yield out

    # The key travels as text: a null would turn a batch of numbers into floats.
    rest = docs.select(F.col("doc_id").cast("string"), _host(), "text").join(maybe_broadcast(bad), "host", "left_semi")
    rest = rest.select("doc_id", "text").mapInPandas(unfailed, "doc_id bigint, n_words int, n_repeated int")
    return failed.unionByName(rest)


def found(docs: DataFrame) -> DataFrame:
    """doc_id of the checked documents whose repeated share reaches the limit."""
    return checked(docs).where((F.col("n_words") > 0) & (F.col("n_repeated") >= SHARE * F.col("n_words") - 1e-9)).select("doc_id")

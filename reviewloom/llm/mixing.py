"""Mixing sources to target weights by Pfair scheduling.

A mixture is a row of slots of one block each. A block has at most `BLOCK` tokens
whatever the size of the data, so ten times the data has ten times the slots. Of
every `PERIOD` slots each source gets a whole number, its weight rounded up; block
j of a source with weight w within the period is released at slot floor(j/w) and
due by slot ceil((j+1)/w), and earliest deadline first fills the slots, so at
every point each source is less than one block from its share. The period is
scheduled once, on the driver, and repeats: block j of a source with h slots a
period stands in period j div h at the place of its block j mod h, which is a
join with a table of `PERIOD` rows and no sort.

Each source's documents, in a fixed pseudo-random order, form a line of tokens
that is repeated as often as it is used; the line is cut into as many blocks as
the source has slots, and every document follows its block's slot. Documents stay
whole, so a source misses its share by half a document and a block at most.

By default every document is used, at least once and at most `max_repeats`
times, and within these bounds each source comes as near to its share as it can
(`balanced`); where bounds keep a source from its target, the report shows the
gap, and the slots are dealt by the tokens that each source gives, so that it is
less than one of its blocks from its reached share. `exact_shares` instead takes the
largest size at which no source needs a document more often than that, which
leaves the rest of the larger sources unused; `total_tokens` asks for a size.
With either, short sources give all that they may. The report has the tokens
left unused.

Cumulative sums run per source and hash bucket of bounded size, the buckets'
own totals are added up in a small table. Documents without a source, of a
source without a target, or without tokens are not used. Equal documents count
each for itself. Without usable documents the result is empty. Other columns
of both tables are not read.
"""

from __future__ import annotations

import heapq
from fractions import Fraction
from math import ceil, floor

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reviewloom.common import cut, short_list
from reviewloom.llm.tokens import DEFAULT_VOCABULARY, token_count

BLOCK = 1024
PERIOD = 2048
BUCKET = 20_000


def pfair(weights: dict[str, float], slots: int) -> list[tuple[str, int, int, int]]:
    """(source, block, release, deadline) for each slot, earliest deadline first."""
    exact = {s: Fraction(w).limit_denominator(1_000_000) for s, w in weights.items() if w > 0}
    whole = sum(exact.values(), Fraction(0))
    if not whole:
        return []
    exact = {s: w / whole for s, w in exact.items()}
    window = lambda s, j: (floor(j / exact[s]), ceil((j + 1) / exact[s]))
    waiting = [(window(s, 0)[0], s, 0) for s in exact]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int, int]] = []
    out = []
    for t in range(slots):
        while waiting and waiting[0][0] <= t:
            r, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, j)[1], s, j, r))
        if not ready:  # rounding of the weights left a slot idle
            r, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (window(s, j)[1], s, j, r))
        d, s, j, r = heapq.heappop(ready)
        out.append((s, j, r, d))
        heapq.heappush(waiting, (window(s, j + 1)[0], s, j + 1))
    return out


def balanced(sizes: dict[str, int], goal: dict[str, tuple[float, int]]) -> dict[str, int]:
    """Tokens to take of each source: its share of their sum, but all its documents once at least and `max_repeats` times at most."""
    exact = {s: Fraction(goal[s][0]).limit_denominator(1_000_000_000_000) for s in sizes}
    whole = sum(exact.values(), Fraction(0))
    take = lambda total: {s: min(max(floor(exact[s] / whole * total), n), goal[s][1] * n) for s, n in sizes.items()}
    # What the sources give for a total grows no faster than the total, so the largest total that they reach is found by halving.
    low, high = 0, sum(goal[s][1] * n for s, n in sizes.items())
    while low < high:
        mid = (low + high + 1) // 2
        # Rounding down may miss a token of each source.
        low, high = (mid, high) if sum(take(mid).values()) + len(sizes) > mid else (low, mid - 1)
    return take(low)


def usable(docs: DataFrame, targets: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, source, n_tokens, h, bucket) of every document that may be used, written once."""
    goal = _goal(targets)
    buckets = max(1, -(-docs.count() // bucket))
    h = F.xxhash64("doc_id", F.lit(7))
    sized = docs.where(F.col("source").isin(*goal)).select("doc_id", "source", token_count(F.col("text"), vocabulary).alias("n_tokens"), h.alias("h"))
    return cut(sized.where("n_tokens > 0").withColumn("bucket", F.pmod("h", F.lit(buckets))))


def _goal(targets: DataFrame) -> dict[str, tuple[float, int]]:
    """Source -> (target share, most uses of a document)."""
    return {r.source: (r.target_share, r.max_repeats) for r in short_list(targets.where("target_share > 0 and max_repeats > 0 and source is not null"))}


def period_of(take: dict[str, int], block: int = BLOCK, period: int = PERIOD) -> tuple[list[tuple[str, int, int, int]], dict[str, tuple[int, int]]]:
    """The schedule of one period, and of each source its slots a period and the tokens of its blocks.

    Slots are rounded up, so a source's blocks have at most `block` tokens; small
    mixtures have one period of smaller blocks.
    """
    total = sum(take.values())
    periods = max(1, -(-total // (block * period)))
    slots = {s: max(1, -(-n * period // total)) for s, n in take.items() if n > 0}
    plan = pfair(slots, sum(slots.values()))
    return plan, {s: (h, -(-take[s] // (h * periods))) for s, h in slots.items()}


_OUT = "slot bigint, source string, block bigint, use_no int, doc_id bigint, n_tokens int, token_offset bigint, release bigint, deadline bigint"


def mix(
    docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, vocabulary: str = DEFAULT_VOCABULARY, block: int = BLOCK, period: int = PERIOD, bucket: int = BUCKET, exact_shares: bool = False, sized: DataFrame | None = None,
) -> DataFrame:
    """One row per use of a document, an ordered mixture: by slot, then token_offset.

    `sized` is usable() of the same tables, where it is at hand. release and
    deadline are those of the document's block.
    """
    spark = docs.sparkSession
    goal = _goal(targets)
    if not goal:
        return spark.createDataFrame([], _OUT)
    sized = usable(docs, targets, vocabulary, bucket) if sized is None else sized
    sums = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("n"))
    sizes = {r.source: int(r.n) for r in short_list(sums.groupBy("source").agg(F.sum("n").alias("n")))}  # a row per target
    if not sizes:
        return spark.createDataFrame([], _OUT)
    present = {s: goal[s] for s in sizes}
    if total_tokens or exact_shares:
        whole = sum(w for w, _ in present.values())
        feasible = min(int(present[s][1] * sizes[s] * whole / present[s][0]) for s in present)
        wanted = {s: int((total_tokens or feasible) * w / whole) for s, (w, _) in present.items()}
        # A short source stops after max_repeats passes; later slots of it stay empty.
        take = {s: min(wanted[s], present[s][1] * sizes[s]) for s in present}
    else:
        wanted = take = balanced(sizes, present)
    plan, dealt = period_of({s: max(1, n) for s, n in wanted.items()}, block, period)

    lines = spark.createDataFrame([(s, sizes[s], take[s], *dealt[s]) for s in sizes], "source string, line bigint, take bigint, per_period bigint, size bigint")
    sched = spark.createDataFrame([(i, s, j, r, d) for i, (s, j, r, d) in enumerate(plan)], "at_slot bigint, source string, at_block bigint, release bigint, deadline bigint")
    before = sums.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).drop("n")
    at = F.sum("n_tokens").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id")) - F.col("n_tokens")
    x = sized.withColumn("at", at).join(before, ["source", "bucket"]).join(F.broadcast(lines), "source")  # a row per target
    x = x.withColumn("start", F.col("at") + F.col("before"))
    # A document is used where its middle lies before the end of its source's share.
    room = F.expr("2 * take - 2 * start - n_tokens - 1")
    x = x.withColumn("room", room).where("room >= 0")
    uses = F.expr("sequence(0, cast(room div (2 * line) as int))")
    x = x.withColumn("use_no", F.explode(uses)).withColumn("token_offset", F.col("start") + F.col("use_no") * F.col("line"))
    x = x.withColumn("block", F.expr("token_offset div size")).withColumns({"at_block": F.expr("block % per_period"), "first": F.expr(f"(block div per_period) * {len(plan)}")})
    x = x.join(F.broadcast(sched), ["source", "at_block"])  # a row per slot of a period
    x = x.withColumns({"slot": F.col("first") + F.col("at_slot"), "release": F.col("first") + F.col("release"), "deadline": F.col("first") + F.col("deadline")})
    return x.select(*[c.split()[0] for c in _OUT.split(", ")])


def shares(mixed: DataFrame, targets: DataFrame, sized: DataFrame | None = None) -> DataFrame:
    """Target and reached share of each source, the uses of its documents and their most.

    With usable() of the tables also the source's tokens and those in no row of the mixture.
    """
    once = F.coalesce(F.sum(F.when(F.col("use_no") == 0, F.col("n_tokens"))), F.lit(0))
    per = mixed.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("uses"), (F.max("use_no") + 1).alias("most_uses"), once.alias("once"))
    x = targets.select("source", "target_share", "max_repeats").join(per, "source", "left").fillna(0, ["tokens", "uses", "most_uses", "once"])
    x = x.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy())), F.lit(0.0)))
    x = x.withColumn("share_gap", F.col("actual_share") - F.col("target_share"))
    if sized is not None:
        x = x.join(sized.groupBy("source").agg(F.sum("n_tokens").alias("usable_tokens")), "source", "left").fillna(0, ["usable_tokens"])
        x = x.withColumn("unused_tokens", F.col("usable_tokens") - F.col("once"))
    return x.drop("once")

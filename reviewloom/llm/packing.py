"""Containers of fixed capacity, filled by bounded-space best fit.

Items arrive in a fixed pseudo-random order. A fixed number of containers are
open; an integer keyed by free space has a bit for every free amount that some
open container has, so the tightest container that still takes an item is one
shift and one lowest-set-bit away. Where none takes it a new one opens, and if
all places are taken the fullest closes first.

Documents are dealt into groups of about `GROUP` by a hash of their id; groups
are packed independently and in parallel, so only the last open containers of
each group stay part-filled. An item above the capacity fills whole containers
first and its rest is packed as an item; nothing else is split.

Null and empty texts have 0 tokens and join the fullest open container. An
unknown or non-positive capacity gives no rows. Repeated documents are packed
each for itself; equal ids stay in one group, null ids too. Other columns are not read.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewloom.common import short_list
from reviewloom.llm.tokens import DEFAULT_VOCABULARY, token_count

GROUP = 20_000
OPEN = 64


def best_fit(sizes: list[int], capacity: int, n_open: int = OPEN) -> list[list[tuple[int, int, int]]]:
    """For each item its pieces: (container, first unit, units)."""
    free_of: dict[int, list[int]] = {}
    bits, used, count, out = 0, 0, 0, []
    for size in sizes:
        pieces, at = [], 0
        while size - at > capacity:
            pieces.append((count, at, capacity))
            count += 1
            at += capacity
        rest = size - at
        if rest == capacity:
            pieces.append((count, at, rest))
            count += 1
            out.append(pieces)
            continue
        fit = bits >> rest
        if fit:
            free = rest + (fit & -fit).bit_length() - 1
            box = free_of[free].pop()
            if not free_of[free]:
                bits &= ~(1 << free)
        else:
            if used == n_open:
                full = (bits & -bits).bit_length() - 1
                free_of[full].pop()
                if not free_of[full]:
                    bits &= ~(1 << full)
                used -= 1
            box, free = count, capacity
            count += 1
            used += 1
        pieces.append((box, at, rest))
        free -= rest
        if free:
            free_of.setdefault(free, []).append(box)
            bits |= 1 << free
        else:
            used -= 1
        out.append(pieces)
    return out


_OUT = "spec_name string, container_id string, doc_id bigint, piece int, first_token int, n_tokens int, capacity_tokens int"


def pack(docs: DataFrame, specs: DataFrame, vocabulary: str = DEFAULT_VOCABULARY, group: int = GROUP, n_open: int = OPEN) -> DataFrame:
    """One row per piece of a document in a container of each capacity."""
    boxes = [(r.spec_name, int(r.capacity_tokens)) for r in short_list(specs.where("capacity_tokens > 0"))]
    if not boxes:
        return docs.sparkSession.createDataFrame([], _OUT)
    groups = max(1, -(-docs.count() // group))
    sized = docs.select(F.col("doc_id").cast("string"), token_count(F.col("text"), vocabulary).alias("n"), F.xxhash64("doc_id").alias("h"))
    sized = sized.withColumn("g", F.pmod("h", F.lit(groups)))

    def fill(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h", "doc_id", "n"], kind="stable")
        ids, sizes, rows = [None if x is None else int(x) for x in pdf.doc_id], pdf.n.tolist(), []
        for name, capacity in boxes:
            for doc, pieces in zip(ids, best_fit(sizes, capacity, n_open)):
                rows += [(name, f"{name}-{key[0]}-{b}", doc, i, a, n, capacity) for i, (b, a, n) in enumerate(pieces)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in _OUT.split(", ")])
        # Nulls among large numbers: never through floats.
        out["doc_id"] = pd.array([r[2] for r in rows], dtype="Int64")
        return out

    # Packing is work for the CPU, not for memory: groups keep tasks of their own, however few bytes they have.
    return sized.repartition(groups, "g").groupBy("g").applyInPandas(fill, _OUT)


def usage(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and the share of space left unused."""
    x = packed.groupBy("spec_name", "container_id", "capacity_tokens").agg(F.sum("n_tokens").alias("n"), F.max("n_tokens").alias("most"))
    return x.groupBy("spec_name", "capacity_tokens").agg(
        F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.max("n").alias("fullest"),
        (1 - F.sum("n") / (F.count("*") * F.first("capacity_tokens"))).alias("unused_share"),
    )

"""CSV, JSON and text inputs and outputs of the pipeline."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import rulesdata as D

PAIRS = "source_column string, source_description string, sample_1 string, sample_2 string, sample_3 string, target_column string, target_description string, source_file string"
NORMALIZED = ", ".join(f"{c} string" for c in D.TARGETS + D.METADATA)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Quoted fields may hold line breaks and doubled quotes; an empty field is null."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "")
    return (r.schema(schema) if schema else r).csv(path)


def write_csv(df: DataFrame, path: str, by: str | None = None) -> None:
    """K1-K3, K5-K8: CSV with a header; `by` gives a folder per value (K2), the column kept. Arrays, maps and structs are written as JSON."""
    df = df.withColumns({c: F.to_json(c) for c, kind in df.dtypes if kind.startswith(("array", "map", "struct"))})
    w = df.withColumn("_part", F.col(by)) if by else df
    out = w.write.mode("overwrite").option("header", True).option("escape", '"')
    (out.partitionBy("_part") if by else out).csv(path)


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """Raises ValueError where a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def sample_columns(df: DataFrame) -> list[str]:
    """P17."""
    return [c for c in df.columns if c.startswith("sample_")]


def read_cache(path: str) -> dict:
    """A JSON cache; a missing file is empty."""
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def write_cache(cache: dict, path: str) -> None:
    """K5: written beside and moved, so a reader never sees half a file."""
    with open(f"{path}.part", "w", encoding="utf-8") as f:
        json.dump(cache, f, ensure_ascii=False, indent=1, sort_keys=True)
    os.replace(f"{path}.part", path)


def write_matches(judged: DataFrame, folder: str) -> None:
    """K6: all results, the accepted ones if any, the votes; one evaluation serves all three."""
    kept = judged.persist()
    try:
        write_csv(kept, f"{folder}/results")
        yes = kept.where("processed_output = 'Yes'")
        if not yes.isEmpty():
            write_csv(yes, f"{folder}/results_yes_only")
        write_csv(kept.select("source_column", "target_column", "output_1", "output_2", "output_3", "processed_output", "unanimous", "agreement_level"), f"{folder}/voting_stats")
    finally:
        kept.unpersist()


def write_candidates(candidates: DataFrame, filtered: DataFrame, folder: str) -> None:
    """K7: the candidate pairs and the pair table reduced to them."""
    write_csv(candidates, f"{folder}/candidates")
    write_csv(filtered, f"{folder}/filtered")

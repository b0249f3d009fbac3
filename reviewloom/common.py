"""Helpers shared by every operator: table access, emptiness, lineage cuts."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# Cells that count as empty.
PLACEHOLDERS = ("-", "x", "X", "~", "nan", "NaN", "NAN")
BLANK = r"^[\s\u00a0\u2000-\u200b\u3000]*$"
# The same for RE2, which the SQL checks use.
BLANK_RE2 = r"^[\s\x{00a0}\x{2000}-\x{200b}\x{3000}]*$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables; a single file or a folder of files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def is_empty(c: Column) -> Column:
    """True where a cell is null, blank or a placeholder."""
    return c.isNull() | c.rlike(BLANK) | c.isin(*PLACEHOLDERS)


def filled(c: Column) -> Column:
    """The cell, or null where it is empty."""
    return F.when(~is_empty(c), c)


def sql_empty(c: str) -> str:
    """The SQL twin of is_empty."""
    return f"({c} IS NULL OR regexp_matches({c}, '{BLANK_RE2}') OR {c} IN ('-','x','X','~','nan','NaN','NAN'))"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a folder of our own on a local master only.

    On a cluster a machine's own folder would be lost with the machine, so there
    the setting is asked for.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or Path(tempfile.mkdtemp(prefix="reviewloom-")).as_uri())
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def short_list(df: DataFrame, most: int = 100_000) -> list[Row]:
    """The rows of a list that is short by its meaning (targets, specifications); raises where it is not."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows in a table that should be a short list")
    return rows


def maybe_broadcast(df: DataFrame, most: int = 1000) -> DataFrame:
    """df as a broadcast table if it has at most `most` rows, which is counted; else as it is.

    For lists (targets, dictionaries) that are short but whose plan does not show it.
    """
    rows = df.limit(most + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= most else df


def spread(scan: DataFrame) -> DataFrame:
    """A scan in at least as many partitions as there are cores.

    Large data has them already and is left alone; only a small input that came
    as a few pieces is dealt out, texts included, before a costly per-row stage.
    The pieces are counted by a query that reads no column. For plain scans: a
    plan with shuffles would run twice.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    pieces = scan.select(F.spark_partition_id().alias("p")).distinct().count()
    return scan.repartition(cores) if pieces < cores else scan


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application.

    Needed wherever the package is not installed on them; the driver's file
    server hands it out, also to executors that come later.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="reviewloom-")) / "reviewloom_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    sc.addPyFile(str(path))
    _SHIPPED.add(sc.applicationId)

"""From typed cells of many workbooks to named columns; one plan for all files.

cells: source_file, sheet, sheet_idx, row_idx, col_idx, cell_value, vtype. Cells
that are null, blank or a placeholder are dropped, and with them empty rows and
columns. Windows run per sheet header or file column list, never over all cells
of all files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from reviewloom import rulesdata as D
from reviewloom.common import cut, is_empty
from reviewloom.functions import rules as R


def clean(cells: DataFrame) -> DataFrame:
    """P2, P3."""
    return cells.where(~is_empty(F.col("cell_value")))


def select_sheet(cells: DataFrame) -> DataFrame:
    """Per file the sheet to read.

    Candidates hold a preferred word and no skipped one; of several the one with
    most rows, the first of equals; without candidates the first sheet.
    """
    low = F.lower("sheet")
    any_of = lambda words: F.greatest(*[low.contains(w) for w in words])
    s = cells.groupBy("source_file", "sheet", "sheet_idx").agg((F.max("row_idx") + 1).alias("n_rows"))
    s = s.withColumn("candidate", F.coalesce(any_of(D.PREFER_SHEETS) & ~any_of(D.SKIP_SHEETS), F.lit(False)))
    order = [F.desc("candidate"), F.when(F.col("candidate"), -F.col("n_rows")), "sheet_idx"]
    return s.withColumn("place", F.row_number().over(W.partitionBy("source_file").orderBy(*order))).where("place = 1").select("source_file", "sheet", "sheet_idx", "n_rows")


def score_rows(cells: DataFrame) -> DataFrame:
    """Header hits, filled cells, mean length and score of each file's first rows."""
    text = F.lower(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "cell_value"))), lambda c: c["cell_value"])))
    v = R.strip(F.col("cell_value"))
    g = cells.where((F.col("row_idx") <= D.LAST_HEADER_ROW) & F.col("cell_value").isNotNull()).groupBy("source_file", "row_idx")
    g = g.agg(text.alias("row_text"), F.count_if(v != "").alias("n_cells"), F.avg(F.when(v != "", F.length(v))).alias("mean_length"))
    hits = sum((F.col("row_text").contains(k)).cast("int") for k in list(D.HEADER_WORDS)[1:]) + F.col("row_text").contains(list(D.HEADER_WORDS)[0]).cast("int")
    g = g.withColumn("hits", hits).withColumn("mean_length", F.coalesce("mean_length", F.lit(0.0)))
    return g.withColumn("score", F.col("hits") - F.least(F.col("mean_length") / D.LENGTH_DIVISOR, F.lit(D.MOST_PENALTY))).drop("row_text")


def header_row(cells: DataFrame) -> DataFrame:
    """Each file's header row; 0 where no row qualifies."""
    s = score_rows(cells)
    ok = s.where((F.col("hits") >= D.LEAST_INDICATORS) & (F.col("n_cells") >= D.LEAST_CELLS))
    best = ok.groupBy("source_file").agg(F.min_by("row_idx", F.struct(-F.col("score"), "row_idx", -F.col("hits"))).alias("row"))
    return cells.select("source_file").distinct().join(best, "source_file", "left").select("source_file", F.coalesce("row", F.lit(0)).alias("header_row"))


def column_names(cells: DataFrame, header: DataFrame) -> DataFrame:
    """Names of a file's non-empty columns; Column_i where the header is empty, suffixes on repeats."""
    data = clean(cells).join(header, "source_file").where(F.col("row_idx") >= F.col("header_row"))
    cols = data.groupBy("source_file", "col_idx").agg(F.max(F.when(F.col("row_idx") == F.col("header_row"), R.strip(F.col("cell_value")))).alias("h"))
    at = F.row_number().over(W.partitionBy("source_file").orderBy("col_idx")) - 1
    cols = cols.withColumn("name", F.coalesce("h", F.concat(F.lit("Column_"), at.cast("string"))))
    k = F.row_number().over(W.partitionBy("source_file", "name").orderBy("col_idx")) - 1
    return cols.withColumn("k", k).select("source_file", "col_idx", F.when(F.col("k") > 0, F.concat("name", F.lit("_"), F.col("k").cast("string"))).otherwise(F.col("name")).alias("source_column"))


def layout(cells: DataFrame) -> DataFrame:
    """Per file and column: sheet_idx, header_row, col_idx, source_column.

    A few rows per file; written once, so that the cells themselves meet it in a
    single join however often the result is used.
    """
    s = select_sheet(cells).select("source_file", "sheet_idx")
    c = cells.join(s, ["source_file", "sheet_idx"])
    h = header_row(clean(c))
    return cut(column_names(c, h).join(h, "source_file").join(s, "source_file"))


def read(cells: DataFrame) -> DataFrame:
    """source_file, row_idx, col_idx, source_column, cell_value, vtype of each file's data cells."""
    x = clean(cells).join(layout(cells), ["source_file", "sheet_idx", "col_idx"]).where(F.col("row_idx") > F.col("header_row"))
    return x.select("source_file", "row_idx", "col_idx", "source_column", "cell_value", "vtype")

"""Schemas that drift between deliveries: a lifespan catalogue of columns.

Every file's header row and typed cells are its footer: exploded, they give one
row per (producer, delivery, column, type). Columns are named by *field* through
an alias table, which is an input with a default. A lag over the deliveries of a
producer turns the presence of a (header, field, type) into islands, the
catalogue of lifespans; the first and last delivery of an island are logged as
a start and an ending, and every change is read from these:

* a start and an ending of one header in one delivery: its type changed;
* a start and an ending of one field, or of columns with like content where the
  alias table does not know a header: renamed, the most alike first, until no
  pair is left;
* what is left over was added or removed.

Content is compared by sketches of fixed size: the least hash in each of
`BUCKETS` buckets, over the words of all cells and over the shapes of all their
parts, so whole cells count and a column of any length costs the same. The alias
table also generates the casts of the unified table.

Nulls: a file without header cells has no columns; empty cells give no type. A
repeated header in one file counts once, at its first position, and columns
without a header are no change; the unified table keeps the cells of both. A
column with no filled data cell has no type and so never changes it. A file whose
`data_structure` is unknown on either side reports no structure change. Empty
tables give no changes. Other columns of the tables are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from reviewloom.common import cut, is_empty, maybe_broadcast

# Field -> headers that name it, as compared by `header_key`.
ALIASES = {
    "comment_id": ("comment id", "id", "id no", "item", "tracking id", "ref number", "identifier", "reference"),
    "comment_text": ("comment text", "comment", "comments", "comments received", "agency comment", "reviewer comment", "comment request"),
    "response_text": ("response text", "response", "company reply", "answer provided", "proponent response", "reply"),
    "author": ("author", "reviewer", "reviewer name", "submitted by", "source author"),
    "date_received": ("date received", "recd", "received on", "submission date", "received"),
    "date_responded": ("date responded", "date of answer", "reply sent", "response date", "date response sent"),
    "status": ("status", "state", "resolution status", "comment status"),
    "agency": ("agency", "organization", "dept", "reviewing body", "reviewer agency", "department"),
    "topic": ("topic", "theme", "discipline", "subject area", "subject"),
    "section": ("section", "document section", "chapter", "sec ref", "reference section"),
    "comment_type": ("comment type", "type", "classification"),
    "round": ("round", "review round", "phase"),
    "comment_text_2": ("comment 2nd round", "follow on comment", "comment r2"),
    "response_text_2": ("response 2nd round", "follow on response", "response r2"),
    "date_received_2": ("date received 2nd round", "received r2", "2nd received"),
    "lead_office": ("lead discipline office", "office lead"),
    "hours": ("hours spent", "effort hours"),
    "priority": ("priority", "urgency", "priority rank"),
    "confidential": ("confidential", "restricted"),
    "deadline": ("deadline", "target date", "due by"),
    "attachment": ("attachment", "enclosure", "attached file"),
    "map_sheet": ("map sheet", "map tile", "mapsheet"),
    "page": ("page", "page number", "pg"),
}
# The type that each unified field is cast to; the rest are text.
CASTS = {"date_received": "date", "date_responded": "date", "date_received_2": "date", "deadline": "date", "round": "int", "hours": "double", "priority": "int"}
TARGET = ("comment_id", "section", "topic", "round", "comment_type", "comment_text", "response_text", "author", "date_received", "date_responded", "status", "agency")


BUCKETS = 64


def header_key(c: Column) -> Column:
    """A header for comparison: lower case, apostrophes dropped, other marks as blanks."""
    c = F.regexp_replace(F.lower(c), "['’]", "")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", " "))


def alias_table(spark: SparkSession, aliases: dict[str, tuple[str, ...]] = ALIASES) -> DataFrame:
    """(header_key, field): the default alias table; any table of this form will do."""
    return spark.createDataFrame([(n, f) for f, names in aliases.items() for n in names], "header_key string, field string")


def deliveries(manifest: DataFrame) -> DataFrame:
    """(project, source_file, seq): each file's place in its producer's deliveries."""
    return manifest.select("project", "source_file", F.row_number().over(W.partitionBy("project").orderBy("delivery_no", "source_file")).alias("seq"))


def _sheet_cells(cells: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cells of each file's data sheet: the named one, else the first; chosen among sheets, not among cells."""
    m = manifest.select("source_file", "sheet_name", "header_row")
    sheets = cells.select("source_file", "sheet", "sheet_idx").distinct().join(m, "source_file")
    named = F.when(F.col("sheet") == F.col("sheet_name"), 0).otherwise(1)
    pick = sheets.groupBy("source_file").agg(F.min(F.struct(named.alias("other"), "sheet_idx"))["sheet_idx"].alias("sheet_idx"), F.first("header_row").alias("header_row"))
    return cells.select("source_file", "sheet_idx", "row_idx", "col_idx", "cell_value", "vtype").join(pick, ["source_file", "sheet_idx"]).drop("sheet_idx")


def sketches(data: DataFrame) -> DataFrame:
    """(source_file, col_idx, shapes, words): sketches of each column's filled cells.

    A cell's shapes are those of its parts between blanks (letters as `a`, digits
    as `9`) and its length as a power of two. Both sketches hold the least hash of
    each bucket; they merge by taking the lesser, so partial aggregates are small.
    """
    v = F.col("cell_value")
    shape = F.regexp_replace(F.regexp_replace(v, r"\p{L}+", "a"), r"\p{Nd}+", "9")
    size = F.concat(F.lit("length "), F.floor(F.log2(F.length(v) + 1)).cast("string"))
    hashes = lambda words, seed: F.transform(words, lambda w: F.struct(F.lit(seed).alias("of"), F.xxhash64(w, F.lit(seed)).alias("h")))
    parts = F.concat(hashes(F.array_append(F.split(F.trim(shape), r"\s+"), size), "shapes"), hashes(F.regexp_extract_all(F.lower(v), F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0)), "words"))
    x = data.select("source_file", "col_idx", F.explode(parts).alias("p")).groupBy("source_file", "col_idx", "p.of", F.pmod("p.h", F.lit(BUCKETS)).alias("bucket")).agg(F.min("p.h").alias("h"))
    return x.groupBy("source_file", "col_idx").agg(*[F.array_sort(F.collect_list(F.when(F.col("of") == k, F.col("h")))).alias(k) for k in ("shapes", "words")])


def likeness(a: Column, b: Column) -> Column:
    """Share of equal buckets of two sketches: an estimate of their sets' Jaccard similarity."""
    filled = F.size(F.array_distinct(F.transform(F.concat(a, b), lambda h: F.pmod(h, F.lit(BUCKETS)))))
    return F.coalesce(F.size(F.array_intersect(a, b)) / F.nullif(filled, F.lit(0)), F.lit(0.0))


def footers(manifest: DataFrame, cells: DataFrame, pairs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(project, source_file, seq, col_idx, header, field, vtype): every column of every file.

    Headers come from the header row; files that have none there take them from
    the column pairs (without a position). header is null for a column that has
    cells and no header. vtype is the type of most filled data cells (ties: by name).
    """
    sheet = _sheet_cells(cells, manifest).where(~is_empty(F.col("cell_value")))
    is_head, is_data = F.col("row_idx") == F.col("header_row"), F.col("row_idx") > F.col("header_row")
    typed = sheet.where(is_head | is_data).groupBy("source_file", "col_idx", "vtype").agg(F.count_if(is_data).alias("n"), F.max(F.when(is_head, F.trim("cell_value"))).alias("header"))
    columns = typed.groupBy("source_file", "col_idx").agg(F.max("header").alias("header"), F.min_by(F.when(F.col("n") > 0, F.col("vtype")), F.when(F.col("n") > 0, F.struct(-F.col("n"), "vtype"))).alias("vtype"))
    listed = pairs.where(F.trim("source_column") != "").select("source_file", F.lit(None).cast("int").alias("col_idx"), F.trim("source_column").alias("header"), F.lit(None).cast("string").alias("vtype")).distinct()
    columns = columns.unionByName(listed.join(columns.where("header is not null").select("source_file").distinct(), "source_file", "left_anti"))
    names = maybe_broadcast((aliases if aliases is not None else alias_table(manifest.sparkSession)).select("header_key", "field"))
    x = deliveries(manifest).join(columns, "source_file").withColumn("header_key", header_key(F.col("header")))
    return x.join(names, "header_key", "left").select("project", "source_file", "seq", "col_idx", "header", "field", "vtype")


def catalogue(manifest: DataFrame, cells: DataFrame, pairs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One row per file and header, with the type and the sketches of its first column: the exploded footers."""
    first = footers(manifest, cells, pairs, aliases).where("header is not null").groupBy("project", "source_file", "seq", "header", "field").agg(F.min(F.struct("col_idx", "vtype")).alias("c"))
    data = _sheet_cells(cells, manifest).where((F.col("row_idx") > F.col("header_row")) & ~is_empty(F.col("cell_value")))
    return first.select("project", "source_file", "seq", "header", "field", "c.col_idx", "c.vtype").join(sketches(data), ["source_file", "col_idx"], "left")


def lifespans(cat: DataFrame) -> DataFrame:
    """Islands of consecutive deliveries per producer, header, field and type: first and last delivery, and the sketches there."""
    key = ["project", "header", "field", "vtype"]
    w = W.partitionBy(*key).orderBy("seq")
    x = cat.withColumn("new", (F.col("seq") - F.lag("seq").over(w) != 1).cast("int"))
    x = x.withColumn("island", F.sum(F.coalesce("new", F.lit(1))).over(w)).withColumn("content", F.struct("shapes", "words"))
    return x.groupBy(*key, "island").agg(
        F.min("seq").alias("first_delivery"), F.max("seq").alias("last_delivery"), F.min_by("content", "seq").alias("first_content"), F.max_by("content", "seq").alias("last_content")
    )


def events(spans: DataFrame, files: DataFrame) -> DataFrame:
    """The log of starts and endings: (project, seq, event, header, field, vtype, content).

    What is there in a producer's first delivery does not start, what is there in the last does not end.
    """
    last = files.groupBy("project").agg(F.max("seq").alias("final"))
    log = F.array(
        F.struct(F.lit("start").alias("event"), F.col("first_delivery").alias("seq"), F.col("first_content").alias("content")),
        F.struct(F.lit("end").alias("event"), (F.col("last_delivery") + 1).alias("seq"), F.col("last_content").alias("content")),
    )
    x = spans.join(last, "project").select("project", "header", "field", "vtype", "final", F.explode(log).alias("e")).select("project", "header", "field", "vtype", "final", "e.*")
    return x.where(F.when(F.col("event") == "start", F.col("seq") > 1).otherwise(F.col("seq") <= F.col("final"))).drop("final")


def changes(manifest: DataFrame, cells: DataFrame, pairs: DataFrame, rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """Every change of a producer's layout: (source_file, change_kind, old_column, new_column)."""
    files = deliveries(manifest)
    # A row per change of a column, used on both sides of the joins below; it is written once.
    log = cut(events(lifespans(catalogue(manifest, cells, pairs, aliases)), files))
    side = lambda event, p: log.where(F.col("event") == event).select("project", "seq", F.col("header").alias(p), F.col("field").alias(f"{p}_field"), F.col("vtype").alias(f"{p}_vtype"), F.col("content").alias(f"{p}_content"))
    starts, ends = side("start", "new"), side("end", "old")
    # One header ending and starting at once has another type there.
    at = ["project", "seq"]
    stays = starts.join(ends.withColumn("new", F.col("old")), [*at, "new"]).select(*at, "old", "new", "old_vtype", "new_vtype")
    s = starts.join(stays.select(*at, "new"), [*at, "new"], "left_anti")
    e = ends.join(stays.select(*at, "old"), [*at, "old"], "left_anti")

    # The field decides; a header unknown to the table pairs by its cells.
    both = s.join(e, at)
    same_key = header_key(F.col("new")) == header_key(F.col("old"))
    shapes, words = (likeness(F.col(f"new_content.{k}"), F.col(f"old_content.{k}")) for k in ("shapes", "words"))
    both = both.withColumns({"by_shape": shapes, "by_word": words})
    alike = (F.col("by_shape") + F.col("by_word")) / 2
    unknown = F.col("new_field").isNull() | F.col("old_field").isNull()
    score = F.when(same_key, 4.0 + alike).when(F.col("new_field") == F.col("old_field"), 2.0 + alike).when(unknown & (F.col("new_vtype") == F.col("old_vtype")) & (F.greatest("by_shape", "by_word") >= 0.5), alike)
    both = both.withColumn("score", score).where(F.col("score").isNotNull())
    # The best pair of a delivery, then the best of the headers still free, until none is left.
    ranked = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("rank"), "new", "old", "new_vtype", "old_vtype")))
    free = lambda got, p: ~F.exists(got, lambda q: (q["new"] == p["new"]) | (q["old"] == p["old"]))
    best = F.aggregate("ranked", F.slice("ranked", 1, 1), lambda got, p: F.when(free(got, p), F.array_append(got, p)).otherwise(got))
    pair = both.groupBy(*at).agg(ranked.alias("ranked")).select(*at, F.inline(best)).drop("rank")

    out = lambda d, kind, old, new: d.select(*at, F.lit(kind).alias("change_kind"), old.alias("old_column"), new.alias("new_column"))
    none, old, new = F.lit(""), F.col("old"), F.col("new")
    typed = pair.select(*at, "old", "new", "old_vtype", "new_vtype").unionByName(stays).where(F.col("old_vtype") != F.col("new_vtype"))
    layout = F.lower(F.trim("data_structure"))
    most = rows.where(layout.isin("long", "wide")).groupBy("source_file", layout.alias("layout")).agg(F.count("*").alias("n"))
    most = most.groupBy("source_file").agg(F.min_by("layout", F.struct(-F.col("n"), "layout")).alias("layout"))
    lay = files.join(most, "source_file", "left").withColumn("old_layout", F.lag("layout").over(W.partitionBy("project").orderBy("seq")))
    every = reduce(DataFrame.unionByName, [
        out(pair, "renamed", old, new), out(typed, "type_changed", old, new),
        out(s.join(pair.select(*at, "new"), [*at, "new"], "left_anti"), "added", none, new), out(e.join(pair.select(*at, "old"), [*at, "old"], "left_anti"), "removed", old, none),
        out(lay.where(F.col("layout") != F.col("old_layout")), "structure_changed", none, none),
    ])
    return every.join(files, at).select("source_file", "change_kind", "old_column", "new_column")


def casts(field: str, c: Column) -> Column:
    """The cast that the alias table gives a unified field; what fails is null."""
    kind = CASTS.get(field)
    if kind == "date":
        return F.coalesce(F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss"))), *[F.try_to_date(c, f) for f in ("yyyy-MM-dd", "dd-MM-yyyy", "MMMM d yyyy", "M/d/yyyy")])
    return c.try_cast(kind) if kind else c


def _placed(manifest: DataFrame, cells: DataFrame, pairs: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """Every filled data cell with its column's field and a name that is unique in its file."""
    cols = footers(manifest, cells, pairs, aliases).where("col_idx is not null")
    twice = cols.where("header is not null").groupBy("source_file", "header").agg((F.count("*") > 1).alias("twice"))
    cols = cols.join(twice, ["source_file", "header"], "left")
    # A repeated header and a missing one are told apart by the column's place.
    named = F.when(F.col("header").isNull(), F.concat(F.lit("Column_"), "col_idx")).when(F.col("twice"), F.concat("header", F.lit("#"), "col_idx")).otherwise(F.col("header"))
    cols = cols.select("project", "source_file", "col_idx", "field", named.alias("name"))
    data = _sheet_cells(cells, manifest).where((F.col("row_idx") > F.col("header_row")) & ~is_empty(F.col("cell_value"))).select("source_file", "row_idx", "col_idx", "cell_value")
    return data.join(cols, ["source_file", "col_idx"])


def unify(manifest: DataFrame, cells: DataFrame, pairs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """One consistent table: a row per data row of every file, a column per target field.

    No filled cell is lost. Of columns of one file naming the same field the
    leftmost filled cell is the field's; every other cell is in `other`, a JSON
    map by header (by header and place where a header repeats, `Column_i` where
    there is none). The text of a cell that its field's cast does not take is in
    `uncast`, a JSON map by field.
    """
    x = _placed(manifest, cells, pairs, aliases)
    x = x.groupBy("project", "source_file", "row_idx").agg(F.array_sort(F.collect_list(F.struct("col_idx", "field", "name", "cell_value"))).alias("cs"))
    cs = F.col("cs")
    of = lambda f: F.get(F.filter(cs, lambda c: c["field"] == f), F.lit(0))["cell_value"]
    x = x.withColumns({f: of(f) for f in TARGET})
    taken = lambda c: F.coalesce(c["field"].isin(*TARGET), F.lit(False)) & ~F.exists(cs, lambda d: (d["field"] == c["field"]) & (d["col_idx"] < c["col_idx"]))
    entry = lambda k, v: F.struct(k.alias("key"), v.alias("value"))
    as_map = lambda entries: F.to_json(F.map_from_entries(F.array_sort(entries)))
    other = as_map(F.transform(F.filter(cs, lambda c: ~taken(c)), lambda c: entry(c["name"], c["cell_value"])))
    failed = F.filter(F.array(*[F.when(casts(f, F.col(f)).isNull() & F.col(f).isNotNull(), entry(F.lit(f), F.col(f))) for f in TARGET if f in CASTS]), lambda e: e.isNotNull())
    return x.select("project", "source_file", "row_idx", *[casts(f, F.col(f)).alias(f) for f in TARGET], other.alias("other"), as_map(failed).alias("uncast"))


def cast_report(manifest: DataFrame, cells: DataFrame, pairs: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(project, source_file, column_name, field, cast_to, n_cells, n_failed) of every column that the alias table casts."""
    x = _placed(manifest, cells, pairs, aliases).where(F.col("field").isin(*CASTS))
    ok, kind = (reduce(lambda w, f: w.when(F.col("field") == f, v(f)), list(CASTS)[1:], F.when(F.col("field") == list(CASTS)[0], v(list(CASTS)[0]))) for v in (lambda f: casts(f, F.col("cell_value")).isNotNull(), lambda f: F.lit(CASTS[f])))
    return x.withColumns({"ok": ok, "cast_to": kind}).groupBy("project", "source_file", F.col("name").alias("column_name"), "field", "cast_to").agg(F.count("*").alias("n_cells"), F.count_if(~F.col("ok")).alias("n_failed"))

"""Generated workbooks through the whole pipeline."""

import datetime as dt
import http.server
import json
import threading

import pytest
from pyspark.sql import functions as F

from reviewloom import pipeline as P
from reviewloom.config import JobConfig
from reviewloom.operators import ingest as I
from reviewloom.operators import matching as M
from reviewloom.operators import models, qa
from reviewloom.operators import drift as D
from reviewloom.sources import files, xlsx


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("books")
    day = dt.datetime(2022, 1, 15)
    xlsx.write_workbook(f"{d}/a_long.xlsx", [("Summary", [["x"]]), ("Comments", [
        ["Title"], [], ["Comment ID", "Author", "Date Received", "Comment", "Response", "Status", "Comment"],
        ["EMLI-001", "Dr.  Jane   Doe", day, "Please clarify", "Done", "closed", "longer comment here"], [],
        ["EMLI-001", "Jane Doe", "03/04/2022", "Second", "-", "Pending", None], [7, "x", 20220105, "Third", "ok", "Withdrawn", None],
    ])])
    xlsx.write_workbook(f"{d}/b_wide.xlsx", [("Data", [
        ["ID", "Date Received", "Comment", "Response", "Date Received", "Comment", "Response", "Comment", "Response"],
        ["AGY-1", "2022-01-05", "c1", "r1", "-", "c2", "r2", None, "r3"], ["AGY-2", "2022-02-05", "c1", None, None, None, None, None, None],
    ])])
    xlsx.write_workbook(f"{d}/c_noid.xlsx", [("Cover", [["a"]]), ("Data", [["few"]]), ("Main Table", [
        ["Author", "Comment Text", "Response", "Status", "Date"], ["Jane Doe, EMLI - Geoscience", "c", "r", "open", "2022-1-5"], ["John", "d", "s", True, None],
    ])])
    xlsx.write_workbook(f"{d}/e_only_summary.xlsx", [("Summary", [["a", "b"], ["c", 1.5]])])
    (d / "bad.xlsx").write_text("no")
    (d / "~lock.xlsx").write_text("no")
    (d / "note.txt").write_text("no")
    return str(d)


def test_cells(spark, folder):
    c = xlsx.cells(spark, folder)
    assert [r.source_file for r in xlsx.errors(c).collect()] == ["bad.xlsx"]
    assert {r.vtype for r in c.select("vtype").distinct().collect()} == {"str", "datetime", "int", "float", "bool", "error"}
    assert {r.source_file: r.sheet for r in I.select_sheet(c.where("vtype <> 'error'")).collect()} == {"a_long.xlsx": "Comments", "b_wide.xlsx": "Data", "c_noid.xlsx": "Main Table", "e_only_summary.xlsx": "Summary"}


def test_no_files(spark, tmp_path):
    assert xlsx.cells(spark, str(tmp_path)).count() == 0


def test_normalized(spark, folder, tmp_path):
    r = I.read(xlsx.cells(spark, folder).where("vtype <> 'error'"))
    m = r.select("source_file", "source_column").distinct().withColumn("header_key", D.header_key(F.regexp_replace("source_column", r"_\d$", ""))).join(D.alias_table(spark), "header_key").drop("header_key").withColumnRenamed("field", "target_column").withColumn("processed_output", F.lit("Yes"))
    files.write_csv(m, str(tmp_path / "m"))
    rows = P.process(spark, folder, str(tmp_path / "out") if (tmp_path / "out").mkdir() is None else "", str(tmp_path / "m"))
    got = {(x.source_file, x.comment_id, x.round): x for x in rows.collect()}
    assert len(got) == 9
    a = got["a_long.xlsx", "EMLI-001", "1"]
    assert (a.comment_text, a.author, a.date_received, a.status, a.agency, a.data_structure) == ("longer comment here", "Jane Doe", "2022-01-15", "Closed", "EMLI", "long")
    assert got["a_long.xlsx", "EMLI-001", "2"].date_received == "2022-03-04" and got["a_long.xlsx", "7", "1"].comment_text == "Third"
    assert got["b_wide.xlsx", "AGY-1", "3"].response_text == "r3" and got["b_wide.xlsx", "AGY-1", "2"].date_received == "2022-01-05"
    assert got["c_noid.xlsx", "1", "1"].agency == "EMLI" and got["c_noid.xlsx", "2", "1"].status in ("", None)
    assert "Rows: 9" in [r.value for r in spark.read.text(str(tmp_path / "out" / "summary")).collect()]
    assert files.read_csv(spark, str(tmp_path / "out" / "combined"), files.NORMALIZED).count() == 9


def test_matching_with_stand_ins(spark, folder):
    pairs = P.column_pairs(I.read(xlsx.cells(spark, folder).where("vtype <> 'error'")))
    got = P.match(pairs)
    assert got.count() == pairs.count() and {"Yes", "Unknown"} <= {r.processed_output for r in got.select("processed_output").distinct().collect()}


def test_source_formats_agree(spark, folder):
    """The binary reader and the data source give the same cells."""
    spark.dataSource.register(xlsx.WorkbookSource)
    a, b = xlsx.cells(spark, folder), spark.read.format("workbook_cells").load(folder)
    assert a.exceptAll(b).where("vtype <> 'error'").isEmpty() and b.exceptAll(a).where("vtype <> 'error'").isEmpty() and a.count() == b.count()


def test_propagated_columns(spark):
    pairs = spark.createDataFrame([("a", "x", "f", 0.5), ("a", "x", "g", 0.5), ("b", "x", "f", 0.5), (None, "x", "f", None)], "source_column string, target_column string, source_file string, similarity_score double")
    judged = spark.createDataFrame([("a", "x", "p", None, "r", "Yes", "No", "Yes", "Yes")], "source_column string, target_column string, prompt_1 string, prompt_2 string, raw_output_1 string, output_1 string, output_2 string, output_3 string, processed_output string")
    got = {(r.source_column, r.source_file): r for r in M.propagate(pairs, judged).collect()}
    assert len(got) == 4 and got["a", "g"].prompt_1 == "p" and got["a", "f"].prompt_2 == "Not generated (filtered out)" and got["a", "f"].processed_output_2 == "No"
    assert (got["b", "f"].raw_output_3, got["b", "f"].processed_output, got["b", "f"].processed_output_1) == ("Not processed (filtered out)", "Unknown", "Unknown") and "similarity_score" not in got["b", "f"].asDict()


def test_command_line(spark, folder, tmp_path, monkeypatch):
    """All steps by the command line: pairs, descriptions, matches, table, questions."""
    out = str(tmp_path)
    assert P.main(["preprocess", folder, out]) == 0
    monkeypatch.setenv("REVIEWLOOM_TOP_K", "3")
    assert P.main(["describe", f"{out}/column_pairs", f"{out}/d"]) == 0
    d = files.read_csv(spark, f"{out}/d/descriptions")
    assert d.count() > 0 and {"source_column", "samples", "source_description_3"} <= set(d.columns)
    assert P.main(["match", f"{out}/column_pairs", out]) == 0
    run = f"{out}/offline_direct_samples_top3"
    matches = files.read_csv(spark, f"{run}/matches")
    assert matches.count() == files.read_csv(spark, f"{out}/column_pairs").count() and {"prompt_1", "raw_output_2", "processed_output_3"} <= set(matches.columns)
    assert files.read_csv(spark, f"{run}/voting_stats").count() == files.read_csv(spark, f"{run}/results").count() <= files.read_csv(spark, f"{run}/filtered").count()
    assert files.read_csv(spark, f"{run}/candidates").groupBy("source_column").count().where("count > 3").isEmpty()
    assert P.main(["full", folder, out, f"{run}/missing"]) == 1 and P.main(["process", folder, out, f"{run}/matches"]) == 0
    assert P.main(["qa", f"{out}/normalized", f"{out}/qa"]) == 0
    assert files.read_csv(spark, f"{out}/qa/results").count() == 15 and "15 of 15 match" in [r.value for r in spark.read.text(f"{out}/qa/log").collect()]


def test_test_modes(spark):
    pairs = spark.range(50).select(F.lit("f").alias("source_file"), F.format_string("c%02d", "id").alias("source_column"), F.lit("t").alias("target_column"))
    names = lambda c: [r.source_column for r in c.test_rows(pairs).collect()]
    assert names(JobConfig(head_rows=2)) == ["c00", "c01"] and len(set(names(JobConfig(sample_rows=5)))) == 5 and names(JobConfig(sample_rows=5)) == names(JobConfig(sample_rows=5))
    assert len(names(JobConfig())) == 50


@pytest.fixture()
def server():
    """A generation server that fails once for each prompt with the word `again`."""
    seen = set()

    class Handler(http.server.BaseHTTPRequestHandler):
        def _send(self, body, code=200):
            data = json.dumps(body).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self):
            self._send({"models": []}, 200 if self.path == "/api/tags" else 404)

        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["prompt"]
            first, _ = prompt not in seen, seen.add(prompt)
            self._send({"response": "" if "again" in prompt and first else f" echo {prompt[-12:]} "})

        def log_message(self, *a):
            pass

    s = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_generation_server(spark, server):
    assert models.server_ready(server) and not models.server_ready("http://127.0.0.1:9")
    ask = models.http_generator(server, "m", failed="none")()
    assert ask(["one", "two again", "three"]) == ["echo one", "none", "echo three"] and models.http_generator(server, "m", retries=2)()(["x again"]) == ["echo x again"]
    assert models.http_generator("http://127.0.0.1:9", "m", failed="none", timeout=1)()(["x"]) == ["none"]
    df = spark.createDataFrame([("hello",), (None,)], "p string").select(models.generate(F.coalesce("p", F.lit("nothing")), models.http_generator(server, "m")).alias("r"))
    assert sorted(r.r for r in df.collect()) == ["echo hello", "echo nothing"]
    assert models.plug_ins("m", server)[1]()(["q"]) == ["echo q"]
    with pytest.raises(ConnectionError):
        models.plug_ins("m", "http://127.0.0.1:9")
    told = qa.server_asker(spark.createDataFrame([(1, "x")], "rec_id int, agency string"), server, "m")
    assert told("How many?").endswith("How many?")


def test_columns_required(spark):
    with pytest.raises(ValueError, match="b"):
        files.require(spark.range(1), ["id", "b"])


def test_cache(tmp_path):
    p = str(tmp_path / "c.json")
    assert files.read_cache(p) == {}
    files.write_cache({"é": 1}, p)
    assert files.read_cache(p) == {"é": 1}

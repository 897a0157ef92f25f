"""Ingestion of folders, streams of files and of generations, and the formats, with expected values by hand."""

import os
import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import conversations as C
from quillspark.operators import ingestion as N
from quillspark.operators import retrieval as R
from quillspark.sources import formats as X
from quillspark.streaming import ingest as I


def state(store):
    return {os.path.basename(r["path"]): (r["status"], r["action"], r["error"]) for r in store.read("ledger").filter(F.col("version") == store.read("ledger").agg(F.max("version")).first()[0]).collect()}


def test_folder_sync(spark, tmp_path):
    src = tmp_path / "src"
    (src / ".hidden").mkdir(parents=True)
    (src / "a.md").write_text("# One\nred apple\n# Two\ngreen tree")
    (src / "b.txt").write_bytes(b"caf\xe9")
    (src / "c.json").write_text("{broken")
    (src / "d.bin").write_text("no")
    (src / "e.docx").write_text("no zip")
    (src / ".hidden" / "f.md").write_text("no")
    store = N.Store(spark, str(tmp_path / "store"))
    assert store.ledger().count() == 0 and store.points().count() == 0
    assert N.sync_folder(spark, str(src), store, 1) == {"processed": 2, "added": 2, "updated": 0, "deleted": 0, "skipped": 0, "errors": 3}
    assert state(store) == {
        "a.md": ("completed", "new", None), "b.txt": ("completed", "new", None), "c.json": ("error", "new", "no valid JSON"),
        "d.bin": ("error", "new", "no loader for: bin"), "e.docx": ("error", "new", "no text plan for: word"),
    }
    assert sorted(r["content"] for r in store.points().collect()) == ["One\n\nred apple", "Paragraph 1\n\ncafé", "Two\n\ngreen tree"]
    os.remove(src / "b.txt")
    (src / "a.md").write_text("# One\nred pear")
    (src / "c.json").write_text('{"k": "v"}')
    (src / "g.txt").write_text("x" * 2500)
    told = N.sync_folder(spark, str(src), store, 2)
    assert told == {"processed": 3, "added": 2, "updated": 1, "deleted": 1, "skipped": 0, "errors": 2}
    assert state(store)["b.txt"] == ("deleted", "deleted", None) and state(store)["c.json"] == ("completed", "new", None)
    assert {r["section"] for r in store.points().collect()} == {"One", "k", "Paragraph 1"}
    assert [r["id"] for r in R.bm25_search(store.index(), "apple", 5).collect()] == [] and R.bm25_search(store.index(), "pear", 5).count() == 1
    # a file that breaks keeps its former version
    (src / "c.json").write_text("{broken again")
    assert N.sync_folder(spark, str(src), store, 3)["errors"] == 3
    assert "k" in {r["section"] for r in store.points().collect()}
    assert {os.path.basename(r["path"]) for r in store.failures().collect()} == {"c.json", "d.bin", "e.docx"}
    want = sorted(map(tuple, store.points().select("id", "content").collect()))
    assert store.compact() == 1 and sorted(map(tuple, store.points().select("id", "content").collect())) == want
    assert store.read("ledger").count() == 6 and store.failures().count() == 3
    told = N.sync_folder(spark, str(src), store, 4)
    assert told["skipped"] == 2 and told["processed"] == 0


def test_awkward_files(spark, tmp_path):
    store = N.Store(spark, str(tmp_path))
    rows = [("a.txt", "same"), ("a.txt", "same"), ("b.txt", None), (None, "x"), ("c.txt", "  "), ("d.txt", "long " * 50_000)]
    files = spark.createDataFrame([(*r, 1) for r in rows], "path string, content string, status int")
    told = N.ingest(files, store, 1, embed=lambda t: F.array(F.length(t).cast("double")))
    assert told["added"] == 2 and told["errors"] == 2
    points = store.points().collect()
    assert len([p for p in points if p["path"] == "a.txt"]) == 1 and all(p["embedding"] == [float(len(p["embedding_text"]))] for p in points)
    assert N.ingest(files.filter("false"), store, 2)["deleted"] == 2 and store.points().count() == 0
    assert N.ingest(files, store, 3, max_bytes=10)["errors"] == 3


def test_file_stream(spark, tmp_path):
    src, mark = tmp_path / "src", str(tmp_path / "mark")
    src.mkdir()
    (src / "a.md").write_text("one")
    (src / "c.bin").write_text("no")
    store, told = N.Store(spark, str(tmp_path / "store")), []
    I.sync_stream(I.read_stream(spark, str(src)), str(src), store, mark, told).awaitTermination(120)
    os.remove(src / "a.md")
    (src / "e.md").write_text("newer")
    I.sync_stream(I.read_stream(spark, str(src)), str(src), store, mark, told).awaitTermination(120)
    assert [(t["added"], t["deleted"]) for t in told] == [(1, 0), (1, 1)]
    assert [r["content"].split()[-1] for r in store.points().collect()] == ["newer"]


def test_streams_one_per_conversation(spark, tmp_path):
    """A stream fed in parts ends as the batch rule says, with the time that the watermark has reached as now."""
    rng = random.Random(3)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", I.STATE_STORE)
    try:
        src, out, mark = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "mark")
        seconds, rows = 0, []
        for part in range(4):
            own = []
            for k in range(12):
                seconds += rng.randint(1, 40)
                own.append((f"c{rng.randint(0, 5)}", f"s{part}-{k}", seconds))
            rows += own
            spark.createDataFrame(own, "conv string, stream string, s long").withColumn("at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("s"))).drop("s").coalesce(1).write.mode("append").parquet(str(src))
            changes = I.newest_streams(spark.readStream.schema("conv string, stream string, at timestamp").parquet(str(src)), "conv", "stream", "at")
            changes.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start().awaitTermination(180)
        found = spark.read.parquet(out)
        ended = {(r["key"], r["stream"]) for r in found.filter("status <> 'live'").collect()}
        live = {(r["key"], r["stream"]) for r in found.filter("status = 'live'").collect()} - ended
        now = F.timestamp_seconds(F.lit(1_700_000_000 + seconds))
        table = spark.read.parquet(str(src))
        want = {(r["conv"], r["stream"]) for r in C.latest_streams(table, "conv", "at", now).collect()}
        assert live == want and ended and found.filter("status = 'expired'").count() > 0
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def sections(df):
    return [(r["path"], r["title"], r["content"], r["level"]) for r in df.orderBy("path", "place").collect()]


def table(spark, *rows):
    return spark.createDataFrame(rows, "path string, content string")


def test_json_sections(spark):
    rows = [("a", '[{"name": "n", "x": {"y": [1, 2]}}, {"z": 1}, 5]'), ("b", '{"id": 1}\n{"id": 2}'), ("c", '{"k": {"a": 1}, "l": 2}'), ("d", "{broken"), ("e", None), ("f", "")]
    assert sections(X.json_sections(table(spark, *rows))) == [
        ("a", "name: n", "name: n\nx:\n  y:\n    [0]: 1\n    [1]: 2", 1), ("a", "z: 1", "z: 1", 1), ("a", "Item 3", "5", 1),
        ("b", "id: 1", "id: 1", 1), ("b", "id: 2", "id: 2", 1), ("c", "k", "a: 1", 1), ("c", "l", "2", 1),
    ]
    deep = '{"a": {"b": {"c": {"d": 1}}}}'
    assert "[Max depth reached]" in X.json_sections(table(spark, ("x", deep)), depth=1).first()["content"]


def test_html_sections(spark):
    page = "<html><head><title>T</title></head><body>pre <b>x</b><nav>no</nav><h1>One</h1><p>a &amp; b<p>c<h2 class='x'>Two <i>it</i></h2><div>d<br>e</div><script>var</script><h3></h3>f</body></html>"
    assert sections(X.html_sections(table(spark, ("a", page), ("b", "plain"), ("c", None)))) == [("a", "Introduction", "pre x", 0), ("a", "One", "a & b\nc", 1), ("a", "Two it", "d\ne\nf", 2), ("b", "Introduction", "plain", 0)]


def test_sql_sections(spark):
    script = "SELECT 1;\r\nCREATE OR REPLACE PACKAGE BODY p.b AS x;\nUPDATE t SET a = 1;\nCREATE TABLE t2 (a int);\n-- note\ncreate view v AS\nSELECT 1; SELECT 2"
    assert [r[1:] for r in sections(X.sql_sections(table(spark, ("a", script), ("b", None), ("c", " ; "))))] == [
        ("SELECT 1", "SELECT 1;", 2), ("PACKAGE_BODY: p.b", "CREATE OR REPLACE PACKAGE BODY p.b AS x;", 1), ("UPDATE t SET a = 1", "UPDATE t SET a = 1;", 2),
        ("TABLE: t2", "CREATE TABLE t2 (a int);", 1), ("-- note", "-- note;", 2), ("VIEW: v", "create view v AS\nSELECT 1; SELECT 2", 1),
    ]


def test_csv_dialects(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n3,\n")
    (tmp_path / "b.csv").write_text("ñ;y;z\n" + "\n".join(f'{i};é;"a;{i}\nb"' for i in range(150)), encoding="latin-1")
    (tmp_path / "c.csv").write_text("only\n")
    (tmp_path / "d.csv").write_text("p\tq, r\n1\t2\n")
    files, parts = X.read_csv(spark, str(tmp_path))
    got = {os.path.basename(r["path"]): (r["delimiter"], r["encoding"], r["row_count"], r["column_count"], r["columns"]) for r in files.collect()}
    assert got == {"a.csv": (",", "UTF-8", 2, 2, ["x", "y"]), "b.csv": (";", "ISO-8859-1", 150, 3, ["ñ", "y", "z"]), "c.csv": (",", "UTF-8", 0, 1, ["only"]), "d.csv": ("\t", "UTF-8", 1, 2, ["p", "q, r"])}
    found = {(os.path.basename(r["path"]), r["place"]): (r["title"], r["content"]) for r in parts.collect()}
    assert found["a.csv", 0] == ("CSV Data (1-2 rows)", "x | y\n--------\n1 | 2\n3 | ")
    assert found["b.csv", 1][0] == "CSV Data (rows 101-150)" and found["b.csv", 1][1].startswith("ñ | y | z\n------------\n100 | é | a;100\nb\n101")
    assert len(found) == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        X.read_csv(spark, str(tmp_path / "none"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().sparkPlan().toString()


def test_current_rows_are_neither_sorted_nor_matched_without_need(spark, tmp_path, monkeypatch):
    files = spark.createDataFrame([("a.txt", "red apple"), ("b.txt", "green pear"), ("c.txt", "blue sky")], "path string, content string")
    store = N.Store(spark, str(tmp_path))
    N.ingest(files, store, 1)
    assert "Join" not in _plan(store.points()) and "Join" not in _plan(store._current("words"))
    again = files.filter("path <> 'c.txt'").withColumn("content", F.when(F.col("path") == "a.txt", "red plum").otherwise(F.col("content")))
    N.ingest(again, store, 2)
    store.write("points", store.read("points").filter("version = 2").withColumn("version", F.lit(3).cast("long")), 3)  # a run that failed before its ledger
    want = [("a.txt", 2), ("b.txt", 1)]
    for few in (10, 0):
        monkeypatch.setattr(N, "BROADCAST_ROWS", few)
        points = store.points()
        assert "SortMergeJoin" not in _plan(points) and sorted(map(tuple, points.select("path", "version").collect())) == want
    store.compact()
    assert "Join" not in _plan(store.points()) and sorted(map(tuple, store.points("place").select("path", "version").collect())) == want
    assert store.index()[2].first()["n_docs"] == 2

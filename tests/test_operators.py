"""Rules with expected values written by hand."""

import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import conversations as C
from quillspark.operators import graph as G
from quillspark.operators import retrieval as R
from quillspark.operators import sync as S
from quillspark.operators.chunking import boundary_chunks, split_at_boundaries
from quillspark.operators.stages import numbered
from quillspark.plans import registry as P
from quillspark.sources import parsers as X
from quillspark.sources.sections import decoded, front_matter, read_files, supported_extensions


def test_interpolation():
    assert P.interpolated({"url": "https://api.weather.com?q={{ciudad}}", "key": "val"}, {"ciudad": "Lima"}) == {"url": "https://api.weather.com?q=Lima", "key": "val"}
    got = P.interpolated({"params": {"query": "{{query}}", "count": 10}, "list": ["{{item1}}", "item2"]}, {"query": "test query", "item1": "first"})
    assert got == {"params": {"query": "test query", "count": 10}, "list": ["first", "item2"]}
    assert P.interpolated({"threshold": "{{level}}"}, {"level": 0.5}) == {"threshold": "0.5"}
    assert set(P.tags_of({"url": "{{ciudad}}", "params": {"k": "{{api_key}}"}, "n": {"d": ["{{deep_val}}"]}})) == {"ciudad", "api_key", "deep_val"}


def test_registry(spark):
    tool = P.configured_tool("t", {"sql": "SELECT {{userId}} AS u, {{action}} AS a"}, (P.Parameter("userId", "integer"),))
    assert [p.name for p in tool.parameters] == ["userId", "action"]
    r = P.Registry()
    r.register(tool)
    with pytest.raises(ValueError):
        r.register(tool)
    got = r.execute(spark, "t", userId=3, action="x' OR 1=1 --")
    assert got.success and tuple(got.data.first()) == (3, "x' OR 1=1 --")
    assert not r.execute(spark, "t", action="x").success
    assert not r.execute(spark, "t", userId="3", action="x").success
    assert r.execute(spark, "none").error == "no such tool: none"
    assert r.by_category() == {"custom": ["t"]}
    assert tool.schema()["function"]["parameters"]["required"] == ["userId", "action"]
    r.unregister("t")
    assert r.get("t") is None


@pytest.mark.parametrize(
    "sql",
    [
        "DROP TABLE t", "SELECT 1; SELECT 2", "insert into t values (1)", "WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", "FROM t INSERT INTO u SELECT *", "SET x = 1", "EXPLAIN SELECT 1", "CREATE TABLE t AS SELECT 1", "",
        "SELECT TRANSFORM(a) USING 'cat' AS (b) FROM t", "BEGIN SELECT 1; END", "/* SELECT */ DELETE FROM t", "MERGE INTO t USING u ON t.a = u.a WHEN MATCHED THEN DELETE",
    ],
)
def test_sql_guard_refuses(spark, sql):
    with pytest.raises(ValueError):
        P.check_select(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 'x' AS update FROM nation", "(select 1)", "VALUES (1), (2)", "WITH a AS (SELECT 1 AS drop) SELECT * FROM a -- insert into t", "SELECT 1 UNION ALL SELECT 2;", "SELECT (SELECT max(create) FROM table_or_view) AS delete"])
def test_sql_guard_takes_queries(spark, sql):
    assert P.check_select(spark, sql) == sql.rstrip(";")


def test_tool_discovery_and_rows(spark, tmp_path, monkeypatch):
    package = tmp_path / "mytools"
    package.mkdir()
    (package / "__init__.py").write_text("")
    (package / "b.py").write_text("from quillspark.plans.registry import Parameter, Tool\nlate = Tool('Late', None)\nsame = Tool('Early', None, 'second')\n")
    (package / "a.py").write_text("from quillspark.plans.registry import Parameter, Tool\nearly = Tool('Early', None, 'first', 'x', (Parameter('n', 'integer'), Parameter('q'), Parameter('m', default='d')))\nother = 3\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    found = P.discover("mytools")
    assert sorted(found) == ["Early", "Late"] and found["Early"].description == "first"
    rows = {r["tool_type"]: r for r in P.tool_rows(spark, found.values()).collect()}
    assert json.loads(rows["early"]["example"]) == {"n": 100, "q": "example_q", "m": "d"}
    assert json.loads(rows["early"]["config_schema"])["properties"]["n"]["required"] is True and json.loads(rows["late"]["example"]) == {}
    first = S.sync_templates(P.tool_rows(spark, []).withColumn("is_active", F.lit(True)), P.tool_rows(spark, found.values()))
    assert {r["action"] for r in first.collect()} == {"insert"}


def test_sql_guard_allows(spark):
    assert P.run_sql(spark, "SELECT ';drop' AS x -- c;\n", {}).first()[0] == ";drop"


def test_tolerant_json(spark):
    texts = ['{"ciudad": "Barcelona"}', 'Sure:\n```json\n{"ciudad": "Madrid"}\n```', "ciudad: Lima\npersona: Juan"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.tolerant_map(F.col("t")).alias("m")).collect()
    assert [r["m"] for r in got] == [{"ciudad": "Barcelona"}, {"ciudad": "Madrid"}, {"ciudad": "Lima", "persona": "Juan"}]


def test_markdown_strip(spark):
    got = spark.range(1).select(T.strip_markdown(F.lit("**bold** *italic* `code` [link](url) ```block```"))).first()[0]
    assert all(w in got for w in ("bold", "italic", "code", "link", "[Code Block]")) and "**" not in got and "```" not in got


def test_chunker_covers_text():
    rng = random.Random(5)
    for _ in range(200):
        text = "".join(rng.choice(["word ", "a. ", "\n\n", "x" * 30]) for _ in range(rng.randint(1, 60)))
        parts = split_at_boundaries(text, 100, 20)
        assert all(0 < len(p) <= 100 for p in parts)
        joined = "".join(parts).replace(" ", "").replace("\n", "")
        assert set(joined) == set(text.replace(" ", "").replace("\n", ""))
    assert split_at_boundaries("x" * 1000, 1000, 200) == ["x" * 1000]
    assert split_at_boundaries("   ", 10, 2) == []
    head = "a" * 51 + "\n\n" + "b" * 60
    assert split_at_boundaries(head, 100, 0)[0] == "a" * 51


def test_chunker_rejects_wide_overlap(spark):
    with pytest.raises(ValueError):
        boundary_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 100, 50)


def test_layered_search_equals_queue(spark):
    rng = random.Random(11)
    for _ in range(3):
        names = [f"n{i:02d}" for i in range(14)]
        pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(30)})
        pairs = [(a, b) for a, b in pairs if a != b]
        edges = spark.createDataFrame(pairs, "src string, dst string")
        info = {r["note"]: r for r in G.degrees(edges).collect()}
        root, cap, depth = pairs[0][0], 8, 3
        near = {n: {b for a, b in pairs if a == n} | {a for a, b in pairs if b == n} for n in names}
        seen, queue = {root: (0, 1)}, [root]
        while queue and len(seen) < cap:
            note = queue.pop(0)
            if seen[note][0] == depth:
                continue
            for b in sorted(near[note] - set(seen), key=lambda b: (info[b]["note_type"] != "hub", info[b]["note_type"] != "index", b)):
                if len(seen) < cap:
                    seen[b] = (seen[note][0] + 1, len(seen) + 1)
                    queue.append(b)
        got = G.layered_search(edges, spark.createDataFrame([("r", root)], "root string, note string"), depth, cap)
        assert {r["note"]: (r["depth"], r["visit"]) for r in got.collect()} == seen


def test_aliases(spark):
    got = spark.range(1).select(G.aliases(F.lit("[[b|x]] [[d#s|al]] [[e|x]]"))).first()[0]
    assert got == {"x": "e", "al": "d#s"}


def test_ladder():
    assert R.ladder(0.5) == [0.4, 0.3] and R.ladder(0.7) == [0.6, 0.5, 0.4, 0.3] and R.ladder(0.3) == []


def test_history_limits(spark):
    rows = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn long, role string, text string")
    with pytest.raises(ValueError):
        C.last_messages(rows, 0)


def test_streams_expire(spark):
    rows = spark.createDataFrame([("a", 1, "2024-01-01 00:00:00"), ("a", 2, "2024-01-01 00:04:00"), ("b", 3, "2023-01-01 00:00:00")], "k string, id int, at string").withColumn("at", F.to_timestamp("at"))
    got = C.latest_streams(rows, "k", "at", F.to_timestamp(F.lit("2024-01-01 00:05:00"))).collect()
    assert [(r["k"], r["id"]) for r in got] == [("a", 2)]


def test_front_matter(spark):
    got = spark.range(1).select(front_matter(F.lit("---\na: 1\nl:\n  - x\n  - y\nq: 'z: w'\n---\nrest"))).first()[0]
    assert got == {"a": "1", "l": "x,y", "q": "z: w"}


def test_catalog_keeps_overrides(spark):
    kinds = "provider string, model_name string, model_type string"
    old = spark.createDataFrame([("o", "gemma3", "reasoning", True), ("o", "r1", "chat", False)], kinds + ", is_custom boolean")
    new = spark.createDataFrame([("o", "gemma3", "chat"), ("o", "r1", "reasoning"), ("o", "n", "chat")], kinds)
    got = {r["model_name"]: (r["model_type"], r["action"]) for r in S.sync_catalog(old, new).collect()}
    assert got == {"gemma3": ("reasoning", "keep"), "r1": ("reasoning", "update"), "n": ("chat", "insert")}


def _zip(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files():
    sheet = "<worksheet><sheetData>" + "".join(f'<row><c t="inlineStr"><is><t>{a}</t></is></c><c><v>{b}</v></c></row>' for a, b in (("n", "v"), ("x", 1), ("y", 2))) + "</sheetData></worksheet>"
    book = '<workbook><sheets><sheet name="S"/></sheets></workbook>'
    assert X.xlsx_sections(_zip({"xl/workbook.xml": book, "xl/worksheets/sheet1.xml": sheet})) == [("S (rows 1-2)", "n | v\nx | 1\ny | 2", 1)]
    slide = "<sld><p><t>Title</t></p><p><t>body</t></p><tbl><tr><tc><p><t>a</t></p></tc><tc><p><t>b</t></p></tc></tr></tbl></sld>"
    assert X.pptx_sections(_zip({"ppt/slides/slide1.xml": slide})) == [("Title", "body\n[TABLA]\na | b", 1)]
    doc = '<document><body><p><t>pre</t></p><p><pPr><pStyle val="Heading1"/></pPr><t>A</t></p><p><t>one</t></p><p><pPr><pStyle val="Heading2"/></pPr><t>B</t></p><p><t>two</t></p></body></document>'
    assert X.docx_sections(_zip({"word/document.xml": doc})) == [("Introduction", "pre", 0), ("A", "one", 1), ("A > B", "two", 2)]


def test_files(spark, tmp_path):
    src = tmp_path / "src"
    (src / ".hidden").mkdir(parents=True)
    (src / "a.md").write_text("one")
    (src / "b.txt").write_bytes(b"caf\xe9")
    (src / "c.bin").write_text("no")
    (src / ".hidden" / "d.md").write_text("no")
    found = read_files(spark, str(src)).select("loader", decoded(F.col("content")).alias("t")).collect()
    assert sorted(map(tuple, found)) == [("markdown", "one"), ("text", "café")]
    assert ".xlsx" in supported_extensions()


def test_parent_expansion_keeps_orphans(spark):
    hits = spark.createDataFrame([("a", "p", 0.5, 0, "x"), ("b", "p", 0.5, 1, "y"), ("c", None, 0.9, 2, "z")], "id string, parent_id string, score double, pos int, content string")
    parents = spark.createDataFrame([("p", "whole")], "parent_id string, parent_content string")
    got = {r["id"]: (r["content"], r["child_count"], r["child_scores"]) for r in R.expand_parents(hits, parents).collect()}
    assert got == {"a": ("whole", 2, [0.5, 0.5]), "c": ("z", 1, [0.9])}


def test_json_round_trip(spark):
    rows = spark.createDataFrame([(1, json.dumps({"k": 1}))], "id long, j string")
    assert rows.select(F.get_json_object("j", "$.k")).first()[0] == "1"


def test_sql_over_named_tables(spark):
    """Names of tables stay names: in comma joins, as aliases and in literals; what the session had before is back."""
    nation = spark.createDataFrame([(1, "x"), (2, "y")], "k int, n string")
    region = spark.createDataFrame([(1, "r")], "k int, r string")
    spark.createDataFrame([("old",)], "o string").createOrReplaceTempView("region")
    tables = {"nation": nation, "region": region}
    assert P.run_sql(spark, "SELECT count(*) AS c FROM nation, region", {}, tables).first()["c"] == 2
    row = P.run_sql(spark, "SELECT n AS nation, 'the nation here' AS t FROM nation WHERE k = 2", {}, tables).first()
    assert row["nation"] == "y" and row["t"] == "the nation here"
    assert spark.table("region").columns == ["o"] and not any(t.name == "nation" for t in spark.catalog.listTables())
    spark.catalog.dropTempView("region")


def test_index_survives_writing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red apple"), (2, "green apple tree"), (3, "blue sky"), (4, None)], "doc_id long, text string")
    index = R.bm25_index(docs)
    R.save_index(index, str(tmp_path))
    want = [tuple(r) for r in R.bm25_search(index, "apple tree sky", 3).collect()]
    assert [tuple(r) for r in R.bm25_search(R.load_index(spark, str(tmp_path)), "apple tree sky", 3).collect()] == want and len(want) == 2


def test_numbering_needs_no_single_task(spark):
    rows = spark.range(0, 1000, 1, 7).selectExpr("id * 37 % 1000 as x")
    got = {r["x"]: r["n"] for r in numbered(rows, [F.col("x")], "n").collect()}
    assert got == {x: x + 1 for x in range(1000)}


def test_words_are_counted_inside_their_row(spark):
    from quillspark.functions.text import tokenize, word_counts

    rows = spark.createDataFrame([(1, "b a bé A b"), (2, ""), (3, None), (4, "x")], "id int, text string")
    got = rows.select("id", word_counts(tokenize(F.coalesce("text", F.lit("")))).alias("t")).orderBy("id").collect()
    assert [[tuple(p) for p in r["t"]] for r in got] == [[("a", 2), ("b", 2), ("bé", 1)], [], [], [("x", 1)]]


def test_an_index_moves_no_text_and_no_posting(spark, tmp_path):
    docs = spark.createDataFrame([(1, "apple tree"), (2, ""), (3, None), (4, "tree tree sky sea")], "doc_id long, text string")
    texts, terms, stats = R.bm25_index(docs, path=str(tmp_path))
    assert texts.count() == 4 and sorted(map(tuple, R.postings(texts).select("id", "term", "tf", "dl").collect()))[0] == (1, "apple", 1, 2)
    assert "Exchange" not in R.postings(texts)._jdf.queryExecution().toString() and [tuple(r) for r in stats.select("n_docs", "avgdl", "n_terms").collect()] == [(4, 1.5, 4)]
    assert {r["term"]: r["df"] for r in terms.collect()} == {"apple": 1, "tree": 2, "sky": 1, "sea": 1}


def test_windows_are_shuffled_once(spark):
    chunks = spark.createDataFrame([(p, i, f"{p}{i}") for p in "ab" for i in range(4)], "parent_id string, chunk_index int, content string")
    hits = spark.createDataFrame([("a", 0, 7), ("b", 2, 8), ("b", 2, 9), ("c", 1, 1)], "parent_id string, chunk_index int, id int")
    found = R.windowed_parents(chunks, hits).select("id", "content", "window_content")
    assert sorted(map(tuple, found.collect())) == [(7, "a0", "a0\na1"), (8, "b2", "b1\nb2\nb3"), (9, "b2", "b1\nb2\nb3")]
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window ") == 1 and "chunk_index#" not in "".join(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line)


def test_texts_reach_python_in_short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    boundary_chunks(spark.createDataFrame([(1, "x")], "doc_id int, text string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "512"

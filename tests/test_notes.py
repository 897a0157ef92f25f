"""Notes and their metadata, with expected values by hand."""

import hashlib
import json
import time

from pyspark.sql import functions as F

from quillspark.functions import metadata as M
from quillspark.operators import graph as G
from quillspark.operators import notes as O
from quillspark.queries import QUERIES

NOTE = """---
title: "T: x"
n: 5 # note
tags:
  - x
  - 'y z'
same:
- p
- q
owner:
  name: Ann
  deep:
    k: v
people:
  - name: A
    age: 3
  - name: B
    langs:
      - en
flow: [a, "b", c]
# comment
empty:
status: ok
status: last
---
# Head #t1
body #t2"""


def one(spark, column, **values):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_front_matter(spark):
    got = one(spark, M.front_matter_paths(F.lit(NOTE)))
    assert got == {
        "title": "T: x", "n": "5", "tags[0]": "x", "tags[1]": "y z", "same[0]": "p", "same[1]": "q", "owner.name": "Ann", "owner.deep.k": "v", "people[0].name": "A", "people[0].age": "3",
        "people[1].name": "B", "people[1].langs[0]": "en", "flow[0]": "a", "flow[1]": "b", "flow[2]": "c", "status": "last",
    }
    assert one(spark, M.promoted(M.front_matter_paths(F.lit(NOTE)), "fm_")) == {"fm_title": "T: x", "fm_n": "5", "fm_status": "last"}
    assert one(spark, M.front_matter_paths(F.lit("no matter"))) == {} and one(spark, M.front_matter_paths(F.lit(None).cast("string"))) is None


def test_front_matter_grows_with_its_lines(spark):
    """Lines are read once: a fold took 16 s for 10,000 keys, as it copied what it had found for every line (F10)."""
    note = "---\n" + "".join(f"k{i}: {i}\n" for i in range(10_000)) + "k0: last\n---\n"
    began = time.time()
    got = spark.range(1).select(M.front_matter_paths(F.concat(F.lit(note), F.col("id").cast("string"))).alias("m")).select(F.size("m"), F.element_at("m", "k0"), F.element_at("m", "k9999"), F.element_at(F.map_keys("m"), -1)).first()
    assert tuple(got) == (10_000, "last", "9999", "k0") and time.time() - began < 8


def test_parts_are_dealt_by_key(spark):
    """A file with one group of rows is one task's; what is costly comes after rows are dealt out (F10)."""
    plan = QUERIES["front_matter"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(p_partkey" in plan


def test_front_matter_of_odd_lines(spark):
    lines = ["-", "- ", "  - a: [x , , 'y #z']", "    b:", "      - c", "      -", "- 'd' # e", "k : v # w", "\tt: u", "l: [", "m: \"n\" o", "é: ü: 5", "#: no", "p: [q]\r", "r: s\rt # u\r", "v: w # x\u2028y"]
    assert one(spark, M.front_matter_paths(F.lit("\n".join(["---", *lines, "---", "- rest"])))) == {
        "[0]": "'d'", "[0].a[0]": "x", "[0].a[1]": "y #z", "[0].b[0]": "c", "k": "v", "l": "[", "m": '"n" o', "é": "ü: 5", "p[0]": "q", "r": "s\rt", "v": "w # x\u2028y",
    }
    assert one(spark, M.front_matter_paths(F.lit("---\r\na: b\r\n---"))) == {} and one(spark, M.front_matter_paths(F.lit("---\na: b\r\nc: d\n---"))) == {"a": "b", "c": "d"}


def test_note_content_of_repeated_keys(spark, tmp_path):
    """A note is made of its own row: repeated keys are not joined with each other, and a row without a key stays (F14)."""
    rows = [(1, "a", "B1", "T1", 1, 1.0), (1, "b", "B2", "T2", 2, 1.0), (None, "c", "B3", "T3", 3, 1.0)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    frame = QUERIES["note_content"](spark, str(tmp_path))
    assert "Join" not in frame._jdf.queryExecution().executedPlan().toString()
    got = {(r["p_partkey"], r["content_md5"]) for r in frame.filter("p_partkey is not null").collect()}
    assert frame.count() == 3 and got == {(1, hashlib.md5(f"**Title**: {n}\n\n# One\nB{k}\n\n### Two\nT{k}".encode()).hexdigest()) for k, n in ((1, "a"), (2, "b"))}


def test_titles_tags_and_content(spark):
    assert one(spark, M.document_title(F.lit(NOTE))) == "Head" and one(spark, M.inline_tags(F.lit("a #b-c #d"))) == ["b-c", "d"]
    assert one(spark, M.document_title(F.lit("none"))) == ""
    sections = F.array(F.struct(F.lit("One").alias("title"), F.lit("text").alias("content"), F.lit(2).alias("level")))
    assert one(spark, M.full_content(M.front_matter_paths(F.lit(NOTE)), sections)) == "**Title**: T: x\nStatus: last\n\n## One\ntext"
    assert one(spark, M.full_content(M.front_matter_paths(F.lit("")), sections)) == "## One\ntext"


def test_truncation_at_every_level(spark):
    deep = {"a": "x" * 600, "l": list(range(9)), "o": {"p": "y" * 501, "q": [{"r": "s" * 600}] * 7}, "n": None, "b": True, "f": 1.5} | {f"k{i}": i for i in range(9)}
    got = json.loads(one(spark, M.truncated_json(F.lit(json.dumps(deep)))))
    assert got == {"a": "x" * 500, "l": [0, 1, 2, 3, 4], "o": {"p": "y" * 500, "q": [{"r": "s" * 500}] * 5}, "n": None, "b": True, "f": 1.5, "k0": 0, "k1": 1, "k2": 2, "k3": 3}
    for text, want in (('"plain"', '"plain"'), ("5", "5"), ("nope", None), ("[]", "[]"), ("{}", "{}"), ('{"a": "q\\"uo\\\\te"}', '{"a":"q\\"uo\\\\te"}')):
        assert one(spark, M.truncated_json(F.lit(text))) == want, text
    assert one(spark, M.truncated_json(F.lit('{"a": {"b": {"c": 1}}}'), depth=1)) == '{"a":{"b":"{\\"c\\":1}"}}'


def test_truncation_reads_a_level_once(spark):
    """A level more adds the same to the plan each time, and the whole is parsed once, not once per part of it (F9)."""
    plans = [spark.range(1).select(M.truncated_json(F.col("id").cast("string"), depth=d).alias("x"))._jdf.queryExecution().analyzed().toString() for d in (1, 2, 3)]
    reads = [p.count("from_json(") for p in plans]
    assert reads[2] - reads[1] == reads[1] - reads[0] and [p.count("parse_json(") for p in plans] == [1, 1, 1]


def test_truncation_of_odd_values(spark):
    cut = lambda text: one(spark, M.truncated_json(F.lit(text)))
    assert cut(None) is None and cut('{"a": 1, "a": 2}') is None and cut(" null ") == "null" and cut(' "x" ') == '"x"'
    assert cut('[null, "[1]", "{", [], {}, 1]') == '[null,"[1]","{",[],{}]'
    assert cut('{"z": null, "a": {"b": [[1, "t"], true]}, "": "é\\n"}') == '{"z":null,"a":{"b":[[1,"t"],true]},"":"é\\n"}'


def test_aliases_both_ways(spark):
    config = F.lit('{"url": "https://x/{{city}}", "q": "{{ town }}", "p": {"lat": "{{a}}{{b}}", "idx": "{{nom}}"}, "l": [{"z": "{{zz}}"}]}')

    def given(**values):
        return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])

    assert one(spark, M.with_aliases(config, given(q="Lima"))) == {"q": "Lima", "town": "Lima"}
    assert one(spark, M.with_aliases(config, given(nom="n", zz="1"))) == {"nom": "n", "zz": "1", "idx": "n", "z": "1"}
    assert one(spark, M.with_aliases(config, given(q="1", town="2"))) == {"q": "1", "town": "2"}


def test_vaults(spark):
    files = ["/v/.obsidian/app.json", "/v/a.md", "/v/d/b.md", "/v/.trash/c.md", "/v/1/2/3/4/5/deep.md", "/w/x.md", "/w/y.txt", "/o.md"]
    asked = ["/v", "/v/", "/v/a.md", "/v/d", "/v/d/b.md", "/v/1/2/3/4/5/deep.md", "/w", "/w/x.md", "/none", None, "/o.md", "/w/y.txt"]
    frame = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    got = {r["path"]: (r["type"], r["vault_root"], r["n_notes"]) for r in O.detect(frame(asked), frame(files)).collect()}
    assert got == {
        "/v": ("vault", "/v", 3), "/v/a.md": ("single_file", "/v", 1), "/v/d": ("subset", "/v", 1), "/v/d/b.md": ("single_file", "/v", 1), "/v/1/2/3/4/5/deep.md": ("single_file", None, 1),
        "/w": ("subset", None, 1), "/w/x.md": ("single_file", None, 1), "/none": ("single_file", None, 0), "/o.md": ("single_file", None, 1), "/w/y.txt": ("single_file", None, 0),
    }


def test_authors_of_tables(spark):
    def cells(path, table, rows):
        return [(path, table, r, c, text) for r, row in enumerate(rows) for c, text in enumerate(row)]

    data = [
        *cells("a", 0, [["Versión", "Fecha", " Resumen ", "AUTOR"], ["1", "x", "y", " "], ["2", "x", "y", "Ann  Smith"], ["3", "x", "y", "Bob"]]),
        *cells("a", 1, [["", "nombre", "fecha"], [" Preparación", "Cleo", ""], ["Otro", "Dan", ""]]),
        *cells("b", 0, [["", "Nombre"], ["preparacion", "Eve"], ["Preparación", "Eve"]]),
        *cells("c", 0, [["k", "v"], ["1", "2"]]),
    ]
    got = {r["path"]: (r["author"], r["authors"], r["has_history"]) for r in O.table_authors(spark.createDataFrame(data, "path string, table int, row int, col int, text string")).collect()}
    assert got == {"a": ("Ann Smith", ["Ann Smith", "Bob", "Cleo"], True), "b": ("Eve", ["Eve"], False), "c": (None, [], False)}
    assert [r[0] for r in spark.createDataFrame([("Plantilla",), (" Ann ",)], "n string").select(M.known_author(F.col("n"))).collect()] == ["", "Ann"]


def test_related_texts(spark):
    picks = spark.createDataFrame([("r", "n1", 1, 1), ("r", "n2", 1, 2), ("r", "n3", 2, 3)], "root string, note string, depth int, place int")
    chunks = spark.createDataFrame([(1, "a" * 400, [1.0, 0.0]), (2, "b", [1.0, 0.0]), (3, "c", [0.0, 1.0]), (4, "d", None)], "id long, content string, embedding array<double>")
    got = O.related_texts(picks, [("n1", [1.0, 0.1]), ("n2", [0.0, 1.0]), ("n3", [-1.0, -1.0])], chunks)
    assert sorted((r["note"], r["id"], len(r["content"])) for r in got.collect()) == [("n1", 1, 350), ("n2", 3, 1)]
    text = O.expanded_context(got, F.lit("up")).first()["context"]
    assert text == f"**↑ [Nivel 1] n1**\n{'a' * 350}\n\n---\n\n**↑ [Nivel 1] n2**\nc\n"
    assert O.related_texts(picks, [], chunks).count() == 0


def test_nearest_hub_stops_and_falls_back(spark):
    edges = [(f"x{k}", "hub") for k in range(6)] + [("hub", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("lone", "e")] + [(f"y{k}", "big") for k in range(9)]
    roots = spark.createDataFrame([("1", "b"), ("2", "hub"), ("3", "e"), ("4", "d")], "root string, note string")
    got = {r["root"]: r["hub"] for r in G.nearest_hubs(spark.createDataFrame(edges, "src string, dst string"), roots, 2).collect()}
    assert got == {"1": "hub", "2": "hub", "3": "big", "4": "big"}

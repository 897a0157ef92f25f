"""Licence scan and mixing against brute force, the corpus pipeline, and what every operator does with awkward tables."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_duplicates import components_by_force

import corpus_pipeline
from quillspark.llm import queries
from quillspark.llm.bpe import bpe_decode, bpe_encode
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.html_extract import extract_main_text
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.language_id import identify_language, train_language_model
from quillspark.llm.license_scan import TEMPLATES, license_scan
from quillspark.llm.mixing import labelled_domains, mix_to_targets
from quillspark.llm.repetition_quality import repetition_quality
from quillspark.llm.sanitise import personal_data
from quillspark.llm.suffix_dedup import suffix_dedup

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def licences_by_force(rows, threshold=0.75, share=0.2):
    """{id: (license, score, origin, dir, lines)} from (id, path, text)."""
    term = re.compile(r"[a-z0-9]+(?:\.[0-9]+)*")
    tf = {n: Counter(term.findall(t.lower())) for n, t in TEMPLATES.items()}
    df = Counter(t for own in tf.values() for t in own)
    idf = lambda t: 1 + math.log((1 + len(tf)) / (1 + df.get(t, 0)))
    norm = lambda own: math.sqrt(sum((k * idf(t)) ** 2 for t, k in own.items()))
    found, declared = {}, {}
    for i, path, text in rows:
        best, words = [], 0
        for line in (text or "").split("\n"):
            own = Counter(term.findall(line.lower()))
            if own and (scores := [(-round(sum(k * idf(t) * o.get(t, 0) * idf(t) for t, k in own.items()) / norm(own) / norm(o), 6), n) for n, o in tf.items()]) and -min(scores)[0] >= threshold:
                best.append(min(scores))
                words += sum(own.values())
        found[i] = (min(best), len(best)) if best else None
        total = len([w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w])
        if best and words >= share * max(1, total):
            folder = re.sub("/?[^/]*$", "", path or "")
            declared[folder] = min(declared.get(folder, min(best)), min(best))
    out = {}
    for i, path, _ in rows:
        if found[i]:
            (s, n), lines = found[i]
            out[i] = (n, -s, "own", None, lines)
            continue
        folder = re.sub("/?[^/]*$", "", path or "")
        while True:
            if folder in declared:
                s, n = declared[folder]
                out[i] = (n, -s, "inherited", folder, 0)
                break
            if not folder:
                out[i] = (None, 0.0, "none", None, 0)
                break
            folder = re.sub("/?[^/]*$", "", folder)
    return out


def test_license_scan_matches_brute_force(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c/x.py", "print(1)"), (3, "a/b/LICENSE", "Licensed under CC BY 4.0."), (4, "a/b/y.py", "code"), (5, "z/q.py", "more code"), (6, None, None), (7, "a/b/c/own.py", "# Licensed under the Apache License, Version 2.0.\n" + "word " * 200), (8, "a/b/c/d/e.py", ""), (9, "ab/x", "licensed under the moon"), (10, "z/a/LICENSE", "Licensed under CC BY-SA 4.0.\nmore"), (11, "z/a/", "the the the"), (12, "a/f.py", "x"),
    ]
    got = {r["doc_id"]: (r["license"], r["score"], r["origin"], r["license_dir"], r["n_license_lines"]) for r in license_scan(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    want = licences_by_force(rows)
    assert {k: (v[0], v[2:]) for k, v in got.items()} == {k: (v[0], v[2:]) for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert got[12][0] == "MIT" and got[2][0] == got[4][0] == "CC-BY-4.0" and got[8][3] == "a/b" and got[5][2] == "none"


def test_license_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [(r["doc_id"], "/".join([*([r["source"]] if r["source"] is not None else []), str(r["doc_id"] // 1000), str(r["doc_id"] // 100), str(r["doc_id"])]), r["text"]) for r in docs]
    want = licences_by_force(rows)
    for r in queries.op3_license_scan(spark, SF).collect():
        w = want[r["doc_id"]]
        assert (r["license"], r["origin"], r["license_dir"], r["n_license_lines"]) == (w[0], *w[2:]) and abs(r["score"] - w[1]) < 2e-6


def spark_hash(word):
    h = xxhash.xxh64_intdigest(word.encode(), seed=42)
    return h - (1 << 64) if h >> 63 else h


def test_mixing_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    targets, buckets = queries.TARGETS, 1 << 14
    rows = {r["doc_id"]: r for r in mix_to_targets(docs, labelled_domains(docs, labels), targets, buckets=buckets).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    words = lambda t: [spark_hash(w) % buckets for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w]
    domain = {r["doc_id"]: "toxic" if r["toxic"] == 1 else "poor" if r["quality"] == 0 else "good" for r in labels.collect()}
    fit = [(domain[i], words(texts[i])) for i in domain if i in texts and texts[i] is not None]
    names = sorted({d for d, _ in fit})
    counts = np.zeros((buckets, len(names)))
    for d, own in fit:
        np.add.at(counts[:, names.index(d)], own, 1)
    logs = np.where(counts.sum(1, keepdims=True) > 0, np.log((counts + 1) / (counts.sum(0) + buckets)), 0)
    prior = np.log([sum(d == n for d, _ in fit) / len(fit) for n in names])
    totals = np.zeros(len(names))
    for i, t in texts.items():
        own = words(t)
        s = logs[own].sum(0) * min(1, 64 / max(1, len(own))) + prior
        p = np.exp(s - s.max())
        assert rows[i]["n_tokens"] == len(own) and np.allclose(rows[i]["posterior"], p / p.sum(), atol=1e-6)
        assert rows[i]["rate"] >= 0 and rows[i]["copies"] in (math.floor(rows[i]["rate"]), math.floor(rows[i]["rate"]) + 1)
        totals += rows[i]["rate"] * len(own) * p / p.sum()
    # no other nonnegative rates come nearer to the targets: the gradient is 0 where a rate is positive, else not below 0
    goal = sum(rows[i]["n_tokens"] for i in rows)
    left = (totals - goal * np.array([targets.get(n, 0) for n in names])) / goal
    for r in rows.values():
        slope = float(np.dot(left, r["posterior"]))
        assert slope > -0.01 and (r["rate"] == 0 or slope < 0.01)


def test_mixing_reaches_targets_it_can_reach(spark):
    words = {"a": "red crimson scarlet", "b": "blue navy azure"}
    labelled = spark.createDataFrame([(d, f"{t} {k}") for d, t in words.items() for k in range(20)], "domain string, text string")
    docs = spark.createDataFrame([(k, words["a" if k % 4 else "b"] + f" n{k}") for k in range(400)], "doc_id long, text string")
    rows = mix_to_targets(docs, labelled, {"a": 0.4, "b": 0.6}, iterations=100, tolerance=1e-5).collect()
    share = sum(r["rate"] * r["n_tokens"] * r["posterior"][0] for r in rows) / sum(r["n_tokens"] for r in rows)
    assert abs(share - 0.4) < 1e-3
    assert {r["rate"] for r in mix_to_targets(docs, labelled.filter("false"), {"a": 1.0}).collect()} == {1.0}


def test_mixing_fit_converges_or_says_so(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labelled = labelled_domains(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = mix_to_targets(docs, labelled, queries.TARGETS).collect()
    goal = sum(r["n_tokens"] for r in rows)
    got = [sum(r["rate"] * r["n_tokens"] * r["posterior"][i] for r in rows) / goal for i in range(3)]
    gap = max(abs(a - b) for a, b in zip(got, (0.9, 0.1, 0.0), strict=True))
    assert gap <= 1.2e-4 and all(abs(r["gap"] - gap) < 1e-5 for r in rows)
    with pytest.raises(RuntimeError, match="not converged"):
        mix_to_targets(docs, labelled, queries.TARGETS, iterations=2)


def test_pipeline_mixture_keeps_clean_documents_and_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    written = Counter(r["doc_id"] for r in corpus_pipeline.mixing_stage(spark, docs, SF).select("doc_id").collect())
    assert all(written[r["doc_id"]] >= 1 for r in labels if r["quality"] == 1 and not r["toxic"])
    assert not any(written[r["doc_id"]] for r in labels if r["toxic"])
    rows = corpus_pipeline.mixing_rates(spark, docs, SF).collect()
    assert {r["doc_id"]: r["copies"] for r in rows if r["copies"]} == dict(written)
    # whoever goes lies mainly in toxic; poor text is short of its target too
    assert all(r["copies"] >= 1 or np.argmax(r["posterior"]) == 2 for r in rows)
    total = sum(r["n_tokens"] for r in rows)
    for i, share in enumerate((0.9, 0.1, 0.0)):
        fitted, real = (sum(r[c] * r["n_tokens"] * r["posterior"][i] for r in rows) / total for c in ("rate", "copies"))
        assert abs(fitted - share) <= rows[0]["gap"] + 1e-5 < 0.01 and abs(real - share) < 0.03


def test_pipeline(spark):
    kept = [spark.read.parquet(f"{SF}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], SF).checkpoint())
    frames = [k.toPandas().sort_values("doc_id") for k in kept]
    assert all(list(k.columns) == kept[0].columns for k in kept[1:-1])
    for before, after in zip(frames, frames[1:], strict=False):
        assert set(after["doc_id"]) <= set(before["doc_id"]) and len(after) > 0
    first, lang, exact, near, mixed, last = frames
    rejected = first[~first["doc_id"].isin(lang["doc_id"])]
    assert len(rejected) < 0.2 * len(first)
    assert not any(any(map(str.isalpha, t or "")) and len(t.split()) > 50 for t in rejected["text"])
    want = lang.assign(key=lang["text"].str.translate(LOWER)).groupby("key")["doc_id"].max()
    assert set(exact["doc_id"]) == set(want)
    parts = components_by_force(list(exact["doc_id"]), list(exact["text"]), 5, 80)
    assert set(near["doc_id"]) == {c for _, c in parts.values()}
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.select("doc_id", "n_tokens").collect())) == sorted(zip(last["doc_id"], last["n_tokens"], strict=True))
    assert set(last["doc_id"]) == set(mixed["doc_id"])


def languages(docs):
    spark = docs.sparkSession
    return identify_language(docs, train_language_model(spark.createDataFrame([("the cat", "en"), ("le chat", "fr")], "text string, lang string")))


def mixing(docs):
    return mix_to_targets(docs, docs.select("text", F.col("source").alias("domain")), {"a": 1.0})


OPERATORS = {
    "repetition_quality": repetition_quality,
    "exact_dedup": exact_dedup,
    "license_scan": license_scan,
    "bpe": lambda d: bpe_decode(bpe_encode(d, queries.vocabulary_path()), queries.vocabulary_path()),
    "language_id": languages,
    "suffix_dedup": suffix_dedup,
    "mixing": mixing,
    "jaccard_join": jaccard_components,
    "html": lambda d: extract_main_text(d, "path", "text"),
    "personal_data": personal_data,
}
EXTRA = "id long, n long, key string, kind string, spans string, bucket int, rep string, label string, _text string, _id long, _n string, term string, host string, template string, _p string"


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_awkward_tables(spark, name):
    f = OPERATORS[name]
    clash = [None] * len(EXTRA.split(", "))
    rows = [(1, "twice the same text here", "a", "p/q"), (1, "twice the same text here", "a", "p/q"), (2, None, None, None), (3, "", "b", ""), (None, "no id but text", "a", "x"), (None, None, None, None), (4, "long " * 60_000, "b", "p/long"), (5, "<p>tie", "b", "p/q"), (6, "<p>tie", "b", "p/q")]
    docs = spark.createDataFrame([(*r, *clash) for r in rows], "doc_id long, text string, source string, path string, " + EXTRA)
    got = f(docs)
    if "doc_id" in got.columns:
        assert sorted(map(str, [r["doc_id"] for r in got.collect()])) == sorted(str(r[0]) for r in rows)
    else:
        assert got.count() == len(rows)
    assert f(docs.filter("false")).count() == 0


AWKWARD = [
    (1, "the cat sat on the mat with the dog and the hat", "en", "a"), (1, "the cat sat on the mat with the dog and the hat", "en", "a"), (2, None, "en", None), (3, "", None, "b"), (None, "the dog has no number at all in the house", "en", "a"),
    (None, None, None, None), (4, "the long " * 20_000, "en", "b"), (5, "THE tie of the two rows here", "en", "a"), (6, "the tie of the two rows here", "en", "a"), (7, "12 34 !", "en", "a"),
]


@pytest.fixture(scope="module")
def awkward(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("awkward"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in AWKWARD], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (1, 1, 0), (5, 0, 0), (None, 1, 1), (99, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_stages_on_awkward_rows(spark, awkward):
    docs = spark.read.parquet(f"{awkward}/documents.parquet")
    ids = lambda df: sorted(map(str, (r["doc_id"] for r in df.collect())))
    found = {name: stage(spark, docs, awkward) for name, stage in corpus_pipeline.STAGES}
    assert all(found[n].columns == docs.columns for n in list(found)[:-1])
    # a text without letters has no language; rows that share an id and a text stay as often as they came, and equal texts of other ids go
    assert ids(found["language_id"]) == sorted(["1", "1", "4", "5", "6", "None"])
    assert ids(found["exact_dedup"]) == sorted(["1", "1", "3", "4", "6", "7", "None", "None"])
    assert set(ids(found["jaccard_join"])) == {"1", "2", "3", "4", "5", "7", "None"}
    assert set(ids(found["mixing"])) == {str(r[0]) for r in AWKWARD}
    tokens = found["bpe"].collect()
    assert len(tokens) == len(AWKWARD) and all(4 * r["n_tokens"] == len(r["ids"]) for r in tokens) and {r["n_tokens"] for r in tokens if r["doc_id"] in (2, 3)} == {0}


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_on_no_rows(spark, awkward, name):
    none = spark.read.parquet(f"{awkward}/documents.parquet").filter("false")
    assert dict(corpus_pipeline.STAGES)[name](spark, none, awkward).count() == 0

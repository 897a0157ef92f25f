"""Exact dedup, suffix-array dedup, repetition quality and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from compare import assert_same, connection

from quillspark.llm import queries
from quillspark.llm.components import connected_components
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.repetition_quality import repetition_quality
from quillspark.llm.suffix_dedup import shared_bytes, suffix_dedup

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_exact_dedup_matches_sql(spark):
    assert_same(queries.op2_exact_dedup(spark, SF), connection(SF), queries.ORACLES["op2_exact_dedup"])


def test_exact_dedup_reads_whole_texts(spark):
    base = "x" * 100
    texts = [base + "a", base + "A", base + "b", None, "", "É", "é", base[:64] + "y", "Hot"] + ["hOT"] * 40
    got = {r["doc_id"]: r for r in exact_dedup(table(spark, texts), prefix_chars=8).collect()}
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    for own in groups.values():
        for i in own:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(own), len(own), i == max(own))
    assert got[7]["text_sha256"] is None and got[0]["text_sha256"] == hashlib.sha256((base + "a").encode()).hexdigest()


def removed_by_force(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(r), sum(gone), runs, kept))
    return out


def passages(seed, n):
    rng = random.Random(seed)
    stock = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(20, 60))) for _ in range(12)]
    texts = []
    for _ in range(n):
        parts = [rng.choice(stock) if rng.random() < 0.4 else "".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 8))]
        texts.append("".join(parts))
    return texts


@pytest.mark.parametrize("crowd", [1, 64])
def test_suffix_dedup_matches_brute_force(spark, crowd):
    texts = [*passages(3, 60), "a" * 200, "ab" * 90, "b" * 23, "b" * 24, "b" * 25, "", None, *["same text that is quite long"] * 5]
    rows = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup(table(spark, texts), length=24, anchor_bytes=8, crowd=crowd).collect()}
    assert [rows[i] for i in range(len(texts))] == removed_by_force(texts, 24)


def test_suffix_dedup_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    want = removed_by_force(list(docs["text"]), 400)
    rows = {r["doc_id"]: r for r in queries.op6_suffix_dedup(spark, SF).collect()}
    assert len(rows) == len(docs) and any(w[1] for w in want)
    for i, (n, gone, runs, kept) in zip(docs["doc_id"], want, strict=True):
        assert (rows[i]["n_bytes"], rows[i]["n_removed"], rows[i]["n_spans"], rows[i]["kept_sha256"]) == (n, gone, runs, hashlib.sha256(kept).hexdigest())


def test_shared_passages_are_seen(spark):
    """Passages of just over 50 words in several documents, none of them long enough to be removed; other texts share nothing."""
    rng = random.Random(4)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))
    passage = [prose(52) for _ in range(5)]
    assert all(240 <= len(p) < 400 for p in passage)
    texts = [f"{prose(rng.randint(5, 90))} {passage[k % 5]} {prose(rng.randint(5, 90))}" for k in range(30)] + [prose(120) for _ in range(30)] + ["", None]
    got = {r["doc"]: r["n_shared"] for r in shared_bytes(table(spark, texts)).collect()}
    assert sorted(got) == list(range(30)) and all(48 <= n <= 400 for n in got.values())
    rows = suffix_dedup(table(spark, texts)).collect()
    assert {r["doc_id"]: r["n_shared"] for r in rows if r["n_shared"]} == got and not any(r["n_removed"] for r in rows)


def quality_by_force(text, least):
    text = text or ""
    w = WORD.findall(text)
    n = len(w)
    grams = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    twice = {i + k for i in range(n - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    repeats, covered = set(), set()
    for i in range(n):
        for j in range(i + 1, n):
            size = 0
            while j + size < n and w[i + size] == w[j + size]:
                size += 1
            if size >= least:
                covered |= {*range(i, i + size), *range(j, j + size)}
                if i == 0 or w[i - 1] != w[j - 1]:
                    repeats.add(tuple(w[i : i + size]))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text)
    return [n, sum(map(len, w)), symbols, dup, len(twice), len(repeats), max(map(len, repeats), default=0), len(covered), n < 50 or 100 * len(twice) > 50 * n]


def test_repetition_quality_matches_brute_force(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("ab") if rng.random() < 0.5 else f"w{rng.randint(0, 9)}é" for _ in range(rng.randint(0, 90))) for _ in range(60)]
    texts += [None, "", " \n", "a a a a a a a a a", "x # y\nx # y\n\n\nz z\rx # y", "one\n" * 70, " ".join(map(str, range(400)))]
    got = {r["doc_id"]: r for r in repetition_quality(table(spark, texts), min_repeat=3).collect()}
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_maximal_repeats", "longest_repeat", "covered_words", "base_failed"]
    for i, t in enumerate(texts):
        want = quality_by_force(t, 3)
        assert [got[i][c] for c in names] == want, t
        assert got[i]["kept"] == (not want[8] and want[7] <= 0.3 * want[0] and want[6] <= 100)


def shingles(text, n=4):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def components_by_force(ids, texts, words=4, percent=85):
    sets, up = [shingles(t, words) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), least[root(i)]) for i in range(len(texts))}


def near_copies(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(8):
        words = [f"t{rng.randint(0, 3000)}" for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 40)):
            own = list(words)
            for _ in range(rng.randint(0, 5)):
                own[rng.randrange(len(own))] = f"u{rng.randint(0, 9999)}"
            texts.append(" ".join(own))
            if rng.random() < 0.1:
                words = own  # a chain away from the first
    shared = " ".join(f"s{k}" for k in range(12))
    texts += [f"{shared} p{k} q{k}" for k in range(30)]
    texts += ["a b", "A b", "a", "a", "", None, "a b c d", "a b c d e", "x y z"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("small", "block"), [(256, 1 << 20), (3, 500)])
def test_jaccard_join_matches_brute_force(spark, small, block):
    texts = near_copies(7)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(table(spark, texts), small=small, block=block).collect()}
    assert got == components_by_force(list(range(len(texts))), texts)


def test_jaccard_join_query_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op8_jaccard_join(spark, SF).collect()}
    assert got == components_by_force(list(docs["doc_id"]), list(docs["text"]))


def test_components(spark):
    links = [(1, 2), (2, 3), (9, 8), (5, 5), (8, 7), (7, 9), *[(k, k + 1) for k in range(100, 140)]]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 7, **dict.fromkeys(range(100, 141), 100)}


AWAY = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from quillspark.llm.jaccard_join import jaccard_components
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")], "doc_id long, text string")
print(sorted(tuple(r) for r in jaccard_components(docs).collect()))
"""


def test_jaccard_join_where_workers_cannot_import_the_package(tmp_path):
    script = AWAY.format(repo=str(Path(__file__).resolve().parents[2]))
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "[(1, 3, 1), (2, 3, 1), (3, 1, 3)]" in ran.stdout, ran.stderr[-2000:]

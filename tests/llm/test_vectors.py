"""Vector codes against SQL and brute force."""

import hashlib
import random

import numpy as np
import pytest
from compare import assert_same, connection

from quillspark.llm import queries
from quillspark.llm.vector_codes import AnnularIndex, codebooks_digest, encode_vectors, with_totals

SF = "/root/testdata/sf0.001"


def test_query_matches_sql(spark):
    assert_same(queries.op11_vector_codes(spark, SF), connection(SF), queries.ORACLES["op11_vector_codes"])


@pytest.mark.parametrize("size", [3, 1000, 1 << 26])
def test_nearest_entries_match_all_distances(size):
    rng = random.Random(size)
    for n in (1, 5, 256):
        entries = [[rng.randint(-size, size) for _ in range(6)] for _ in range(n)]
        rows = [[rng.randint(-size, size) for _ in range(6)] for _ in range(700)] + entries
        which, away = AnnularIndex(np.array(entries), probes=4).nearest(np.array(rows), block=64)
        for k, row in enumerate(rows):
            best = min((sum((a - b) ** 2 for a, b in zip(row, e, strict=True)), i) for i, e in enumerate(entries))
            assert (away[k], which[k]) == best


def codes_by_force(rows, parts, entries, rounds):
    """{id: (code, error)} and codebooks, with lists and integers only."""
    from math import floor

    rows = [(i, [floor(1024 * x) for x in v]) for i, v in sorted(rows)]
    wide = len(rows[0][1]) // parts
    cuts = [[v[p * wide : (p + 1) * wide] for p in range(parts)] for _, v in rows]
    books = [[c[p] for c in cuts[:entries]] for p in range(parts)]
    nearest = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(books[p]))
    for _ in range(rounds):
        new = []
        for p in range(parts):
            own = {}
            for c in cuts:
                own.setdefault(nearest(p, c[p])[1], []).append(c[p])
            new.append([[sum(col) // len(own[i]) for col in zip(*own[i], strict=True)] if i in own else e for i, e in enumerate(books[p])])
        books = new
    out = {}
    for (i, _), c in zip(rows, cuts, strict=True):
        best = [nearest(p, c[p]) for p in range(parts)]
        out[i] = (bytes(b[1] for b in best), sum(b[0] for b in best))
    return out, books


def test_codes_match_brute_force(spark):
    rng = random.Random(4)
    vectors = [(k, [rng.choice([-1, 1]) * rng.random() for _ in range(12)]) for k in range(150)] + [(200 + k, [0.25] * 12) for k in range(40)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(7)
    rows, books = encode_vectors(table, parts=4, entries=16, rounds=3)
    want, wanted = codes_by_force(vectors, 4, 16, 3)
    assert {r["vec_id"]: (bytes(r["code"]), r["error"]) for r in rows.collect()} == want and books.tolist() == wanted


def test_awkward_vectors(spark, tmp_path):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5] * 8, 1), (1, [0.5] * 8, 1), (2, None, 1), (3, [0.5] * 7 + [None], 2), (4, [nan] * 8, 2), (5, [inf] * 8, None), (6, [0.1] * 7, 3), (7, [0.1] * 12, 3), (8, [], 3), (None, [-0.5] * 8, None), (9, [3.0e38] * 8, None)]
    table = spark.createDataFrame([(*r, "x", b"y") for r in rows], "vec_id long, embedding array<float>, label int, error string, code binary")
    table.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op11_vector_codes(spark, str(tmp_path)).collect()
    assert sorted((r["vec_id"] or 0, r["code"]) for r in got) == [(0, "03030303"), (1, "00000000"), (1, "00000000"), (9, "02020202")]
    assert {r["label_error"] for r in got} == {0}
    none, books = encode_vectors(table.filter("false"), keep=("label",))
    assert none.count() == 0 and none.columns == ["vec_id", "label", "code", "error"] and codebooks_digest(books) == hashlib.sha256(b"").hexdigest()


def test_totals_by_key_with_hot_and_null_keys(spark):
    rows = [(k, "hot" if k % 3 == 0 else None if k % 3 == 1 else f"k{k}", k) for k in range(300)]
    got = with_totals(spark.createDataFrame(rows, "id long, key string, v long"), "key", "v", "total", share=10).collect()
    sums = {}
    for _, key, v in rows:
        sums[key] = sums.get(key, 0) + v
    assert sorted((r["id"], r["total"]) for r in got) == [(i, sums[key]) for i, key, _ in rows]
    assert got[0].asDict().keys() == {"id", "key", "v", "total"}

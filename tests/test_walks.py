"""Walks of the note graph against plain queues."""

import random
from collections import defaultdict

from quillspark.operators import graph as G


def _graph(seed):
    rng = random.Random(seed)
    return sorted({(f"n{rng.randrange(40):02d}", f"n{int(rng.random() ** 2 * 40):02d}") for _ in range(140)})


def _links(edges):
    into, out = defaultdict(set), defaultdict(set)
    for a, b in edges:
        into[b].add(a)
        out[a].add(b)
    return into, out


def _rows(df):
    return sorted((r["root"], r["depth"], r["visit"], r["note"]) for r in df.collect())


def _queue(start, depth, most, near, stop=()):
    """near: the neighbours of a note in their order; one of `stop` ends its parent's turn."""
    seen, todo, out = {start}, [(start, 0)], [(start, 0, 1)]
    for note, d in todo:
        if d == depth or len(seen) >= most:
            continue
        for x in [x for x in near(note) if x not in seen]:
            if len(seen) >= most:
                break
            seen.add(x)
            todo.append((x, d + 1))
            out.append((x, d + 1, len(seen)))
            if x in stop:
                break
    return out


def test_upward_and_downward_equal_queues(spark):
    for seed in (1, 2):
        edges = _graph(seed)
        into, out = _links(edges)
        names = sorted({x for e in edges for x in e})
        hubs = sorted((n for n in names if len(into[n]) > 5), key=lambda n: (-len(into[n]), n))
        df = spark.createDataFrame(edges, "src string, dst string")
        roots = spark.createDataFrame([(n, n) for n in names[:12]], "root string, note string")
        up = sorted((n, d, v, x) for n in names[:12] for x, d, v in _queue(n, 3, 8, lambda k: sorted(into[k], key=lambda m: (-len(into[m]), m)), hubs[:3]))
        assert _rows(G.walk(df, roots, "up", 3, 8)) == up

        def score(m):
            return 10.0 / (abs(len(into[m]) + len(out[m]) - 5) + 1)

        down = sorted((n, d, v, x) for n in names[:12] for x, d, v in _queue(n, 2, 12, lambda k: sorted(out[k] - {k}, key=lambda m: (-score(m), m))))
        assert _rows(G.walk(df, roots, "down", 2, 12)) == down


def test_hub_first(spark):
    edges = [(f"a{i}", "h") for i in range(6)] + [("h", "x"), ("x", "y"), ("z", "w")]
    df = spark.createDataFrame(edges, "src string, dst string")
    roots = spark.createDataFrame([("1", "y"), ("2", "z"), ("3", "h")], "root string, note string")
    assert {r["root"]: r["hub"] for r in G.nearest_hubs(df, roots).collect()} == {"1": "h", "2": "h", "3": "h"}
    found = _rows(G.hub_first_search(df, roots))
    assert [x[3] for x in found if x[0] == "1" and x[1] < 2] == ["y", "h"]
    assert {x[3] for x in found if x[0] == "1"} == {"y", "h", "x", *(f"a{i}" for i in range(6))}


def test_layers_and_summary(spark):
    layers = spark.createDataFrame([("r", "r", 0, 1)] + [("r", f"a{i:02d}", 1, 2 + i) for i in range(12)] + [("r", f"b{i}", 2, 14 + i) for i in range(4)], "root string, note string, depth int, visit int")
    assert [r["note"] for r in G.best_per_layer(layers).orderBy("place").collect()] == ["a00", "a01", "a02", "a03", "a04", "b0", "b1", "b2"]
    assert [r["note"] for r in G.best_per_layer(layers, deepest_first=True).orderBy("place").collect()][:5] == ["b0", "b1", "b2", "b3", "a00"]
    text = G.context_summary(layers).first()["summary"]
    assert text.startswith("From r, notes: 17\nLevel 0: r\nLevel 1: a00, ") and "(+2)" in text

"""Exact Jaccard join of word n-gram sets as a metric-space join: pivots, Voronoi regions and triangle-inequality windows.

A sample of documents gives a tree of pivots (PivotTree). It splits the whole table into Voronoi regions by Jaccard
distance, level by level; documents near a boundary are replicated into every region that the triangle inequality does
not rule out, so that two documents that link meet in one region at least. Documents that link with a pivot are settled
at once. What remains of a region meets by shared shingles (the first few of each document, rare ones first, which linked
documents cannot all miss), is sifted by parity maps, and compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import bitmap_bits, blocks_of, cut, hash_filter, maybe_in, mixed, packed, short_batches, span_hashes, word_bounds
from quillspark.llm.components import connected_components

_SKETCH = 1 << 22  # buckets of a task's sketch of frequent shingles
_FAR = -1  # the region of documents that are near no pivot


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """The sorted set of hashed shingles of each text: `words` words each, or all words of a text with fewer."""
    out: list[np.ndarray] = []
    for a, b in blocks_of(texts):
        data, starts = packed(texts[a:b])
        s, e = word_bounds(data)
        h = span_hashes(data, s, e, lower=True)
        first = np.searchsorted(s, starts)
        for k in range(b - a):
            w = h[first[k] : first[k + 1]]
            n = min(words, len(w))
            if not n:
                out.append(np.zeros(0, np.uint64))
                continue
            g = np.full(len(w) - n + 1, n, np.uint64)
            for j in range(n):
                g = mixed(g) + w[j : len(w) - n + 1 + j]
            out.append(np.unique(mixed(g)))
    return out


def _prefix(n: int, percent: int) -> int:
    """A partner misses n - ceil(percent * n / 100) members at most, so one of this many first members is shared."""
    return n - (percent * n + 99) // 100 + 1


def _bits(n: int) -> int:
    return max(64, 2 << max(n - 1, 1).bit_length())


def _parity(members: np.ndarray) -> bytes:
    """One bit per residue of the members' hashes: their parity. Two such maps differ in no more bits than the sets do."""
    bits = _bits(len(members))
    counts = np.bincount((members % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(counts.astype(np.uint8), bitorder="little").tobytes()


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _scan(docs: DataFrame, words: int) -> DataFrame:
    """Set size and 128-bit fingerprint per document, and per task the sketch buckets that are locally frequent."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, seen = np.zeros(_SKETCH, np.int32), 0
        for batch in batches:
            sets = shingle_sets(list(batch["text"]), words)
            digest = [np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64) if len(s) else (0, 0) for s in sets]
            for s in sets:
                seen += len(s)
            if sets:
                flat = np.concatenate(sets) % np.uint64(_SKETCH)
                np.add.at(sketch, flat.astype(np.int64), 1)
            yield pd.DataFrame({"heavy": False, "id": batch["id"], "n": [len(s) for s in sets], "fa": [d[0] for d in digest], "fb": [d[1] for d in digest]})
        hot = np.flatnonzero(sketch >= max(4, 8 * seen / _SKETCH))
        hot = hot[np.argsort(-sketch[hot], kind="stable")[: 1 << 14]]
        yield pd.DataFrame({"heavy": True, "id": hot, "n": sketch[hot], "fa": 0, "fb": 0})

    return docs.mapInPandas(scan, "heavy boolean, id long, n long, fa long, fb long")


def _need(n: int, m: int, percent: int) -> int:
    """Least common size with which sets of sizes n and m link: common >= percent / (100 + percent) * (n + m)."""
    return -(-percent * (n + m) // (100 + percent))


def _plausible(n: int, one: int, m: int, two: int, percent: int) -> bool:
    """Whether sizes and parity maps allow a link. Exact: no link is lost."""
    common = _need(n, m, percent)
    if common > min(n, m):
        return False
    a, b = _bits(n), _bits(m)
    while a > b:
        a //= 2
        one = (one ^ one >> a) & ((1 << a) - 1)
    while b > a:
        b //= 2
        two = (two ^ two >> b) & ((1 << b) - 1)
    return (one ^ two).bit_count() <= n + m - 2 * common


class PivotTree:
    """A tree of pivots for sets of shingles under the Jaccard distance, and the way of a set through it.

    Pivots of one level are more than `far` apart; a sampled set closer than that to one of them becomes a pivot below
    it, recursively, but for sets that link with it. At each level a set whose nearest pivot is at most `far` away lives in that pivot's
    cell and is a guest in every cell whose pivot is at most twice the link distance farther; others live in the level's
    far cell, where sets come as guests whose nearest pivot is more than far - link distance away. Two sets that link
    meet: if both live in cells, the triangle inequality makes one a guest of the other's; if one lives in the far cell,
    the other's nearest pivot cannot be closer than far - link distance.
    """

    def __init__(self, ids: list[int], sets: list[np.ndarray], percent: int, depth: int = 4):
        self.percent, self.radius = percent, 1 - percent / 100 + 1e-9
        self.far = 0.95 - 2 * self.radius
        self.ids, self.sizes = ids, np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(flat, kind="stable")
        self.flat, self.owner = flat[order], owner[order]
        self.sketch = np.zeros(1 << 22, bool)
        self.sketch[(flat % np.uint64(1 << 22)).astype(np.int64)] = True
        away = [self.distances(s)[0].astype(np.float32) for s in sets]
        self.levels: list[tuple[int, list[int], dict[int, int]]] = []  # region of the far cell, pivots, level below each
        self.root = self._level(list(range(len(sets))), away, depth)

    def _level(self, members: list[int], away: list[np.ndarray], depth: int) -> int:
        chosen: list[int] = []
        below: dict[int, list[int]] = {}
        for k in members:
            near = min(chosen, key=lambda p: away[k][p], default=None)
            if near is None or away[k][near] > self.far:
                chosen.append(k)
            elif away[k][near] > self.radius - 1e-6:
                below.setdefault(near, []).append(k)
        mine = len(self.levels)
        self.levels.append((-1 - mine, chosen, {}))
        if depth > 1:
            for p, own in below.items():
                self.levels[mine][2][p] = self._level(own, away, depth - 1)
        return mine

    def distances(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distance of a set to every pivot, and which pivots it links with."""
        away, linked = np.ones(len(self.ids)), np.zeros(len(self.ids), bool)
        hits = s[self.sketch[(s % np.uint64(1 << 22)).astype(np.int64)]]
        if len(hits):
            left, right = np.searchsorted(self.flat, hits, "left"), np.searchsorted(self.flat, hits, "right")
            n = right - left
            at = np.repeat(left - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
            common = np.bincount(self.owner[at], minlength=len(self.ids))
            union = len(s) + self.sizes - common
            away, linked = 1 - common / union, 100 * common >= self.percent * union
        return away, linked

    def regions(self, away: np.ndarray) -> list[int]:
        """Leaf regions of a set: a pivot's place, or a level's far cell (below 0; -1 is that of the first level)."""
        out, open_ = [], [self.root]
        while open_:
            name, pivots, below = self.levels[open_.pop()]
            d = away[pivots] if pivots else np.ones(1)
            least = d.min()
            if least > self.far - self.radius:
                out.append(name)
            if least <= self.far:
                for k in np.flatnonzero(d <= least + 2 * self.radius).tolist():
                    p = pivots[k]
                    if p in below:
                        open_.append(below[p])
                    else:
                        out.append(p)
        return out


def _pivot_sets(rows: DataFrame, light: DataFrame, words: int, pivots: int, most: int) -> tuple[list[int], list[np.ndarray]]:
    """Ids and sets of at most `pivots` documents with at most `most` shingles, chosen by a hash of the id."""
    lot = F.pmod(F.xxhash64(F.lit("pivot"), F.col("id")), F.lit(1 << 30))
    able = light.filter((F.col("n") > 0) & (F.col("n") <= most) & F.col("id").isNotNull())
    n = able.count()
    chosen = able.filter(lot < int((1 << 30) * min(1.0, 2 * pivots / max(1, n)))) if n > 2 * pivots else able
    ids = cut(chosen.select("id", lot.alias("lot")).distinct().orderBy("lot", "id").limit(pivots).select("id"))
    texts = rows.join(F.broadcast(ids), "id").groupBy("id").agg(F.min("text").alias("text")).orderBy("id")
    found = [(r["id"], shingle_sets([r["text"]], words)[0]) for r in texts.toLocalIterator()]  # one text at a time
    return [i for i, _ in found], [s for _, s in found]


def _by_group(batches: Iterator[pd.DataFrame]) -> Iterator[list[tuple]]:
    """The rows of one group (first column) after another, from batches sorted by group."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch[c].tolist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _frames(found: Iterator[tuple], columns: list[str]) -> Iterator[pd.DataFrame]:
    out: list[tuple] = []
    for row in found:
        out.append(row)
        if len(out) >= 1 << 14:
            yield pd.DataFrame(out, columns=columns, dtype="int64")
            out = []
    if out:
        yield pd.DataFrame(out, columns=columns, dtype="int64")


def _forest_of(rows: list[tuple], percent: int) -> Iterator[tuple[int, int, int]]:
    """Plausible pairs (group, a, b) that connect whatever is connected by plausible pairs in a group.

    rows: group, id, n, map, core. Members with one core (the pivot that they link with) are connected already.
    """
    ids, sizes = [r[1] for r in rows], [r[2] for r in rows]
    maps = [int.from_bytes(r[3], "little") for r in rows]
    forest, first = _Forest(len(rows)), {}
    for k, r in enumerate(rows):
        if r[4] >= 0:
            forest.join(k, first.setdefault(r[4], k))
    for k in range(1, len(rows)):
        for j in range(k):
            if forest.root(j) != forest.root(k) and _plausible(sizes[j], maps[j], sizes[k], maps[k], percent):
                forest.join(j, k)
                yield rows[k][0], min(ids[j], ids[k]), max(ids[j], ids[k])


def _rest_of(rows: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """All plausible pairs of a group (or of a block of one) whose ends are in different components.

    rows: group, id, n, map, component, asks. At least one end of a pair asks.
    """
    maps = [int.from_bytes(r[3], "little") for r in rows]
    for k, (_, i, n, _, c, asks) in enumerate(rows):
        for j in range(k):
            _, i2, m, _, c2, asks2 = rows[j]
            if c != c2 and (asks or asks2) and _plausible(n, maps[k], m, maps[j], percent):
                yield min(i, i2), max(i, i2)


def _verified(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Texts travel, once for each end of a pair; sets are made where both meet."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    bits = bitmap_bits(2 * pairs.count())  # pairs are cut
    near = maybe_in(texts, F.col("id"), cut(hash_filter(wanted, F.col("id"), bits)), "_near", bits).filter("_near").select("id", "text")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[int, np.ndarray] = (0, np.zeros(0, np.uint64))
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            for k, (one, (b, two)) in enumerate(zip(shingle_sets(list(batch["text"]), words), zip(batch["b"].tolist(), batch["text2"], strict=True), strict=True)):
                if known[0] != b or not len(known[1]):
                    known = (b, shingle_sets([two], words)[0])
                other = known[1]
                at = np.minimum(np.searchsorted(other, one), len(other) - 1)
                common = int((other[at] == one).sum())
                ok[k] = 100 * common >= percent * (len(one) + len(other) - common)
            yield batch.loc[ok, ["a", "b"]]

    both = pairs.select("a", "b").join(near.withColumnRenamed("id", "a"), "a").join(near.select(F.col("id").alias("b"), F.col("text").alias("text2")), "b")
    return cut(both.select("a", "b", "text", "text2").mapInPandas(check, "a long, b long"))


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, percent: int = 85, small: int = 256, block: int = 2048, pivots: int = 512, pivot_shingles: int = 4096
) -> DataFrame:
    """One row per row of docs: id (long), n_shingles, component_id.

    Two documents link if 100 * |common| >= percent * |union| of their sets of `words`-word shingles, A-Z lower-cased;
    component_id is the least id reachable over links. A text without words (or null) has no shingles and no links; a
    null id stays a row of its own. Equal sets form one class, represented by its least id; repeated rows are such a
    class. Extra columns are ignored; no rows give no rows.

    Regions: PivotTree over at most `pivots` sampled documents of at most pivot_shingles shingles; only these are broadcast. Inside a
    region all documents order shingles alike, frequent ones (from a sketch of fixed size) last, and each meets others
    by the first few of its own: linked sets miss so few of each other's members that they share one of these. Such
    groups with the same members are one, and groups of documents that link with the same pivot are settled. Plausible
    pairs (by size and parity map) that connect a group are compared exactly; where a comparison fails, all other
    plausible pairs of its groups that are not connected by then follow. A group with more than `small` members is not
    gathered: its members are compared with up to 8 hubs, and those outside its largest component with all others, in
    blocks of `block`. Comparisons are exact on 64-bit hashed shingles.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    scanned = cut(_scan(rows, words))
    light = scanned.filter("not heavy").select("id", "n", "fa", "fb")
    heavy = scanned.filter("heavy").groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "id").limit(1 << 16).toPandas()
    able = light.filter("n > 0 and id is not null")
    classes = cut(able.groupBy("fa", "fb").agg(F.min("id").alias("rep")))
    order = np.argsort(heavy["id"].to_numpy(np.int64))
    tree = PivotTree(*_pivot_sets(rows, classes.join(light, ["fa", "fb"]).filter("id = rep").select("id", "n"), words, pivots, pivot_shingles), percent)
    # a broadcast pickles classes by name, and executors need not have this package: the tree travels as bytes
    shared_values = spark.sparkContext.broadcast((heavy["id"].to_numpy(np.int64)[order], heavy["n"].to_numpy(np.int64)[order], cloudpickle.dumps(tree)))

    # one row per class: a row that is certainly its class's only candidate needs no join
    odd = able.join(classes, ["fa", "fb"]).filter("id <> rep").select("id").unionByName(able.groupBy("id").count().filter("count > 1").select("id"))
    told = maybe_in(rows.filter("id is not null"), F.col("id"), cut(hash_filter(odd, F.col("id"))), "_odd")
    reps = classes.select(F.col("rep").alias("id"))
    texts = told.filter("not _odd").select("id", "text").unionByName(cut(told.filter("_odd").select("id", "text").join(reps, "id", "left_semi").dropDuplicates(["id"])))

    def heads_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, counts, router = shared_values.value
        router = cloudpickle.loads(router)
        for batch in batches:
            out = []
            for i, s in zip(batch["id"].tolist(), shingle_sets(list(batch["text"]), words), strict=True):
                if not len(s):
                    continue
                n = _prefix(len(s), percent)
                if len(buckets):
                    b = (s % np.uint64(_SKETCH)).astype(np.int64)
                    at = np.minimum(np.searchsorted(buckets, b), len(buckets) - 1)
                    first = s[np.lexsort((s, np.where(buckets[at] == b, counts[at], 0)))[:n]]
                else:
                    first = s[:n]
                away, linked = router.distances(s)
                out.append((i, len(s), _parity(s), np.flatnonzero(linked), router.regions(away), first.view(np.int64)))
            yield pd.DataFrame(out, columns=["id", "n", "map", "links", "regions", "tokens"])

    heads = cut(texts.mapInPandas(heads_of, "id long, n long, map binary, links array<int>, regions array<int>, tokens array<long>"))
    shared_values.destroy()  # heads lie in the checkpoint folder: nothing needs the tree again
    tree.flat = tree.owner = tree.sketch = None
    # pivots that some document links with are connected: at most pivots ** 2 pairs, and so a label for every pivot
    ties = _Forest(len(tree.ids))
    for a, b in heads.filter("size(links) > 1").select(F.get("links", F.lit(0)).alias("a"), F.explode("links").alias("b")).filter("a <> b").distinct().collect():
        ties.join(a, b)
    labels = [ties.root(k) for k in range(len(tree.ids))]
    core = F.get(F.array(*map(F.lit, labels)), F.get("links", F.lit(0))) if labels else F.lit(None)
    heads = heads.withColumn("core", F.coalesce(core.cast("int"), F.lit(-1))).drop("links")
    short = heads.select("id", "n", "map", "core")
    pivot_ids = F.array(*map(F.lit, tree.ids)).cast("array<bigint>")
    links = heads.filter("core >= 0").select(F.col("id").alias("a"), F.get(pivot_ids, F.col("core")).alias("b")).filter("a <> b")
    posted = heads.select("id", "core", F.explode("regions").alias("region"), "tokens").select("id", "core", "region", F.explode("tokens").alias("token"))
    posted = posted.select("id", "core", F.when(F.col("region") == _FAR, F.col("token")).otherwise(F.xxhash64("region", "token")).alias("token"))
    # shingles of two documents of a region or more; a bitmap keeps most of the others from a second shuffle
    shared = cut(posted.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("token"))
    bits = bitmap_bits(shared.count())
    open_ = maybe_in(posted, F.col("token"), hash_filter(shared, F.col("token"), bits), "_open", bits).filter("_open").select("token", "id", "core")
    tokens = open_.groupBy("token").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.min("id").alias("first"), F.max("id").alias("last"), F.min("core").alias("low"), F.max("core").alias("high"))
    open_tokens = tokens.filter("m > 1 and not (low >= 0 and low = high)")
    groups = cut(open_tokens.groupBy("m", "x", "first", "last").agg(F.min("token").alias("group")))
    members = cut(open_.join(groups.filter("m > 2").select(F.col("group").alias("token"), "m"), "token").select(F.col("token").alias("group"), "m", "id"))

    def sift_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = [_plausible(n, int.from_bytes(x, "little"), m, int.from_bytes(y, "little"), percent) for n, x, m, y in zip(*(batch[c].tolist() for c in ("n", "map", "n2", "map2")), strict=True)]
            yield batch.loc[np.array(ok, bool), ["a", "b"]]

    two = groups.filter("m = 2").select(F.col("first").alias("a"), F.col("last").alias("b")).distinct()
    two = two.join(short.select(F.col("id").alias("a"), "n", "map"), "a").join(short.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("map").alias("map2")), "b")
    pairs = two.select("a", "b", "n", "map", "n2", "map2").mapInPandas(sift_pairs, "a long, b long")

    few = members.filter(F.col("m") <= small).select("group", "id").join(short, "id").select("group", "id", "n", "map", "core")

    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((e for own in _by_group(batches) for e in _forest_of(own, percent)), ["group", "a", "b"])

    edges = few.repartition("group").sortWithinPartitions("group").mapInPandas(forest, "group long, a long, b long")
    many = cut(members.filter(F.col("m") > small).select("group", "id").join(short, "id").select("group", "id", "n", "map", "core"))
    crowds = not many.isEmpty()
    if crowds:
        edges = edges.unionByName(_to_hubs(many, percent))
    edges = cut(edges)
    pairs = cut(pairs.unionByName(edges.select("a", "b")).distinct())
    links = links.unionByName(_verified(pairs, texts, words, percent))
    comps = connected_components(links)

    # groups with a comparison that failed, and members of crowds outside the largest component
    comp = short.select("id", "n", "map").join(comps.withColumnRenamed("component", "c"), "id", "left").withColumn("c", F.coalesce("c", "id"))
    comp = cut(comp)
    ends = edges.join(comps.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(comps.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
    failed = cut(ends.filter("coalesce(ca, a) <> coalesce(cb, b)").select("group").distinct())
    again = members.filter(F.col("m") <= small).join(failed, "group", "left_semi").select("group", "id").join(comp, "id").select("group", "id", "n", "map", "c", F.lit(True).alias("asks"))

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((e for own in _by_group(batches) for e in _rest_of(own, percent)), ["a", "b"])

    more = again.repartition("group").sortWithinPartitions("group").mapInPandas(rest, "a long, b long")
    if crowds:
        blocks = _blocks(cut(many.drop("core").join(comp.select("id", "c"), "id")), block)
        more = more.unionByName(blocks.repartition("group").sortWithinPartitions("group").mapInPandas(rest, "a long, b long"))
    more = cut(more.distinct().join(pairs, ["a", "b"], "left_anti"))
    if not more.isEmpty():
        late = _verified(more, texts, words, percent)
        late = late.join(comps.select(F.col("id").alias("a"), F.col("component").alias("ca")), "a", "left").join(comps.select(F.col("id").alias("b"), F.col("component").alias("cb")), "b", "left")
        over = connected_components(late.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))).withColumnRenamed("component", "top")
        joined = comps.join(over.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
        comps = cut(joined.unionByName(over.select("id", F.col("top").alias("component")).join(comps.select("id"), "id", "left_anti")))
    named = classes.join(comps.select(F.col("id").alias("rep"), "component"), "rep", "left")
    named = cut(named.select("fa", "fb", F.coalesce("component", "rep").alias("component_id")))
    own = light.withColumn("_lone", (F.col("n") == 0) | F.col("id").isNull())
    joined = own.withColumn("fa", F.when(F.col("_lone"), F.xxhash64("id")).otherwise(F.col("fa"))).join(named, ["fa", "fb"], "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("_lone"), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _to_hubs(many: DataFrame, percent: int) -> DataFrame:
    """group, a, b: each member of a crowd with the first of the group's 8 hubs with which a link is plausible."""
    lot = F.xxhash64(F.lit("hub"), F.col("id"))
    hubs = many.groupBy("group", F.pmod(lot, F.lit(8)).alias("k")).agg(F.min(F.struct(lot.alias("h"), "id", "n", "map", "core")).alias("hub"))
    hubs = cut(hubs.groupBy("group").agg(F.array_sort(F.collect_list("hub")).alias("hubs")))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, known = [], (None, [])
            for group, i, n, own, core, hubs in zip(*(batch[c] for c in ("group", "id", "n", "map", "core", "hubs")), strict=True):
                if known[0] != group:
                    known = (group, [(h["id"], h["n"], int.from_bytes(h["map"], "little"), h["core"]) for h in hubs])
                mine = int.from_bytes(own, "little")
                for hub, m, other, c in known[1]:
                    if hub == i or core >= 0 and core == c:
                        break
                    if _plausible(n, mine, m, other, percent):
                        out.append((group, min(i, hub), max(i, hub)))
                        break
            yield pd.DataFrame(out, columns=["group", "a", "b"], dtype="int64")

    return many.join(hubs, "group").select("group", "id", "n", "map", "core", "hubs").mapInPandas(nearest, "group long, a long, b long")


def _blocks(many: DataFrame, block: int) -> DataFrame:
    """Members of crowds dealt into blocks, in which those outside the largest component meet all others once.

    many: group, id, n, map, c. Crowds with the same largest component are one: each member and each that asks stands there once.
    A member that asks goes to the blocks (own place, every place), all others to the blocks (place of an asking member,
    own place). Crowds in one component need none.
    """
    counts = many.groupBy("group", "c").agg(F.count(F.lit(1)).alias("k"))
    sizes = counts.groupBy("group").agg(F.sum("k").alias("m"), F.max(F.struct("k", "c")).alias("top"))
    open_ = cut(sizes.filter("m > top.k").select("group", F.col("top.c").alias("main")))
    rows = cut(many.join(open_, "group").groupBy("main", "id").agg(F.first("n").alias("n"), F.first("map").alias("map"), F.first("c").alias("c")))
    dealt = rows.groupBy("main").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    rows = rows.join(dealt, "main").withColumn("spot", F.pmod(F.xxhash64(F.lit("block"), F.col("id")), F.col("blocks")))
    ask = rows.filter("c <> main")
    busy = ask.select("main", "spot").distinct().groupBy("main").agg(F.collect_set("spot").alias("spots"))
    head = ["main", "id", "n", "map", "c"]
    asks = ask.select(*head, F.lit(True).alias("asks"), F.col("spot").alias("i"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("j"))
    rest = rows.join(busy, "main").select(*head, F.lit(False).alias("asks"), F.explode("spots").alias("i"), F.col("spot").alias("j"))
    both = asks.unionByName(rest).groupBy(F.xxhash64("main", "i", "j").alias("group"), "id", "c").agg(F.first("n").alias("n"), F.first("map").alias("map"), F.max("asks").alias("asks"))
    return both.select("group", "id", "n", "map", "c", "asks")

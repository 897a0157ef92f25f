"""Removal of long repeated byte strings: enhanced suffix arrays of buckets of suffixes, scanned as interval trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import _MIX, blocks_of, cut, hash_filter, maybe_in, mixed, packed, powers, short_batches
from quillspark.llm.suffix import dense_ranks, lcp_intervals, suffix_array

_PLACE = 30  # low bits of a minimiser's key hold its place
_OPEN = 1 << 25  # bits of the map of anchors that occur again
_ROWS = "key long, seg long, doc long, start long, anchor int, more int"


def _totals(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_MIX[data] * up[: len(data)], out=total[1:])
    return total, down


def _hashes(total: np.ndarray, down: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return mixed((total[e] - total[s]) * down[s] ^ (e - s).astype(np.uint64) << np.uint64(44))


def segments(texts: list[str | None], length: int, k: int) -> dict[str, np.ndarray]:
    """The buckets of all windows of `length` bytes, run by run.

    The least hash of a window's k-byte strings (the leftmost of equals) names its bucket: equal windows have it at the
    same place. Windows that start one after the other and share one such anchor make a segment: `of` (text), `start`
    (first window), `anchor` (from there to the anchor), `more` (further windows), `key` (hash of the anchor) and `seg`
    (hash of all bytes of the segment with the anchor's place).
    """
    data, starts = packed(texts)
    total, down = _totals(data)
    n = len(data) - k + 1
    first, last = starts[:-1], starts[1:] - 1 - length  # of each text: first and last window
    long = last >= first
    empty = np.zeros(0, np.int64)
    if n <= 0 or not long.any():
        return {c: empty for c in ("of", "start", "anchor", "more", "key", "seg")}
    grams = mixed((total[k:] - total[:n]) * down[:n])
    mask = np.uint64((1 << _PLACE) - 1)
    low = (grams & ~mask) | np.arange(n, dtype=np.uint64)
    width, reach = length - k + 1, 1
    while reach * 2 <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if width > reach:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    counts = (last - first + 1)[long]
    of = np.repeat(np.flatnonzero(long), counts)
    s = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + first[of]
    at = (low[s] & mask).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (of[1:] != of[:-1]))))
    more = np.diff(np.append(new, len(s))) - 1
    s, at, of = s[new], at[new], of[new]
    seg = _hashes(total, down, s, s + more + length) ^ mixed((at - s).astype(np.uint64) + np.uint64(7))
    return {"of": of, "start": s - first[of], "anchor": at - s, "more": more, "key": grams[at].view(np.int64), "seg": seg.view(np.int64)}


def repeated_starts(groups: np.ndarray, texts: list[bytes], more: np.ndarray, length: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, list[tuple[int, int]]]]]:
    """Windows that occur again inside their group of segments, and the maximal repeats behind them.

    One enhanced suffix array over all segments; suffixes of different groups differ in their first symbol. Its stack
    scan gives the common-prefix intervals of at least `length` bytes. Returns runs (segment, first start, last start),
    and for each interval whose occurrences are preceded by different bytes (or begin a segment) the group, the common
    length in whole symbols and all occurrences as (segment, start).
    """
    block = length // 4 if length % 4 == 0 else 1  # bytes that the array takes as one symbol to begin with
    sizes = np.array([len(t) for t in texts])
    base = np.concatenate(([0], np.cumsum(sizes + block)))
    data = np.frombuffer(b"".join([t + b"\0" * block for t in texts]), np.uint8)
    of = np.repeat(np.arange(len(texts)), sizes + block)
    n = len(data)
    room = np.maximum(base[of] + sizes[of] - np.arange(n), 0)
    total, down = _totals(data)
    at = np.arange(n)
    symbol = _hashes(total, down, at, np.minimum(at + block, n))
    symbol = mixed(symbol ^ groups[of].view(np.uint64))
    symbol[room < block] = np.arange((room < block).sum(), dtype=np.uint64)  # no suffix goes on past its segment
    order, lcp = suffix_array(dense_ranks(symbol), room, block, length)
    found = np.zeros(n + 1, bool)
    repeats = []
    for left, right, common in lcp_intervals(lcp, length):
        places = order[left : right + 1]
        found[places] = True
        inner = places > base[of[places]]
        if not inner.all() or len(set(data[places - 1].tolist())) > 1:
            repeats.append((int(groups[of[places[0]]]), int(common), [(int(of[p]), int(p - base[of[p]])) for p in places]))
    found[:-1] &= np.arange(n) - base[of] <= more[of]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], found)).astype(np.int8)))
    runs = [(int(of[a]), int(a - base[of[a]]), int(b - 1 - base[of[a]])) for a, b in zip(edge[::2], edge[1::2], strict=True)]
    return runs, repeats


def _classified(rows: DataFrame, crowd: int) -> tuple[DataFrame, DataFrame]:
    """Different segments with their number of occurrences and one of these; keys with their number of segments."""
    kinds = rows.groupBy("key", "seg").agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("doc", "start", "anchor", "more")).alias("one"))
    kinds = cut(kinds)
    keys = kinds.groupBy("key").agg(F.sum("times").alias("all"), F.count(F.lit(1)).alias("kinds")).filter("all > 1")
    return kinds, cut(keys.withColumn("crowded", F.col("kinds") > crowd))


def _whole(rows: DataFrame, kinds: DataFrame, length: int) -> DataFrame:
    """Runs of windows of all occurrences of segments that occur again as they are."""
    again = cut(kinds.filter("times > 1").select("key", "seg"))
    return rows.select("key", "seg", "doc", "start", "more").join(again, ["key", "seg"], "left_semi").select("doc", F.col("start").alias("a"), (F.col("start") + F.col("more") + length).alias("b"))


def _in_groups(rows: DataFrame, length: int) -> DataFrame:
    """Runs of repeated windows in groups of a few different segments (key, doc, start, more, times, bytes)."""
    size = 1 << 20

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def settle(frame: pd.DataFrame) -> pd.DataFrame:
            groups = mixed(frame["key"].to_numpy(np.int64).view(np.uint64)).view(np.int64)
            runs, _ = repeated_starts(groups, list(frame["bytes"]), frame["more"].to_numpy(np.int64), length)
            doc, start = frame["doc"].to_numpy(np.int64), frame["start"].to_numpy(np.int64)
            return pd.DataFrame([(doc[k], start[k] + a, start[k] + b + length) for k, a, b in runs], columns=["doc", "a", "b"], dtype="int64")

        total = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            total += int(batch["bytes"].map(len).sum())
            if total < size:
                continue
            frame = pd.concat(held, ignore_index=True)
            whole = frame["key"] != frame["key"].iloc[-1]  # the last group may go on
            done = frame[whole].reset_index(drop=True)
            held = [frame[~whole]]
            total = int(held[0]["bytes"].map(len).sum())
            for _, part in done.groupby((done["bytes"].map(len).groupby(done["key"], sort=False).transform("sum").where(done["key"] != done["key"].shift(), 0).cumsum() // size).to_numpy(), sort=False):
                yield settle(part.reset_index(drop=True))
        if held:
            frame = pd.concat(held, ignore_index=True)
            if len(frame):
                yield settle(frame)

    return rows.select("key", "doc", "start", "more", "bytes").repartition("key").sortWithinPartitions("key").mapInPandas(scan, "doc long, a long, b long")


def _split(rows: DataFrame, length: int, width: int) -> DataFrame:
    """Segments of crowded keys cut by the anchor's place in the window, `width` places each.

    The bytes that all windows of such a part have in common join the key: equal windows still meet. With width 1 the
    part is one window, and its hash settles it.
    """

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, doc, start, anchor, more, raw in zip(*(batch[c] for c in ("key", "doc", "start", "anchor", "more", "bytes")), strict=True):
                raw, anchor, more = bytes(raw), int(anchor), int(more)
                total, down = _totals(np.frombuffer(raw, np.uint8))
                js = np.arange((anchor - more) // width, anchor // width + 1)
                near, far = js * width, js * width + width - 1
                s = anchor - np.minimum(far, anchor)
                e = anchor - np.maximum(near, anchor - more)
                left, right = anchor - near, np.minimum(anchor - far + length, len(raw))
                name = mixed(_hashes(total, down, left, right) ^ mixed(js.astype(np.uint64)) ^ np.uint64(key & (1 << 64) - 1))
                seg = _hashes(total, down, s, e + length) ^ mixed((anchor - s).astype(np.uint64) + np.uint64(7))
                for k in range(len(js)):
                    out.append((name[k].view(np.int64), seg[k].view(np.int64), doc, start + s[k], anchor - s[k], e[k] - s[k], raw[s[k] : e[k] + length] if width > 1 else b""))
            yield pd.DataFrame(out, columns=["key", "seg", "doc", "start", "anchor", "more", "bytes"])

    return rows.select("key", "doc", "start", "anchor", "more", "bytes").mapInPandas(scan, _ROWS + ", bytes binary")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, anchor_bytes: int = 32, crowd: int = 64) -> DataFrame:
    """doc, a, b: byte ranges that together cover every `length`-byte string that starts anywhere else too.

    Suffixes are dealt into buckets by the anchors of their windows (see `segments`). A segment that occurs again byte
    for byte needs no comparison; of the others in its bucket one copy each is compared. Buckets of up to `crowd`
    different segments go, many at a time, into an enhanced suffix array. A bucket with more is not gathered: its
    segments are cut by the anchor's place into parts of 16 windows, whose common bytes refine the bucket, and parts
    still crowded are cut into single windows, whose hashes are counted. Nothing is capped.
    """
    spark = docs.sparkSession
    short_batches(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = list(batch["text"]), batch["doc"].to_numpy(np.int64)
            for a, b in blocks_of(texts, 1 << 20):
                got = segments(texts[a:b], length, anchor_bytes)
                yield pd.DataFrame({"key": got["key"], "seg": got["seg"], "doc": ids[a:b][got["of"]], "start": got["start"], "anchor": got["anchor"].astype(np.int32), "more": got["more"].astype(np.int32)})

    found = cut(rows.mapInPandas(scan, _ROWS))
    # an anchor of one place only repeats nothing: a bitmap keeps most of these from all later shuffles
    twice = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = maybe_in(found, F.col("key"), cut(hash_filter(twice, F.col("key"), _OPEN)), "_open", _OPEN).filter("_open").drop("_open")
    kinds, keys = _classified(found, crowd)
    spans = _whole(found, kinds, length)

    # one copy of each different segment in a bucket of several, with its bytes
    open_keys = keys.filter("kinds > 1").select("key", "crowded")
    wanted = cut(kinds.join(open_keys, "key").select("key", "seg", "times", "crowded", "one.*"))
    asked = wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "seg", "times", "crowded", "start", "anchor", "more")).alias("asked"))

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc, text, own in zip(batch["doc"], batch["text"], batch["asked"], strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                for x in own:
                    out.append((x["key"], x["seg"], doc, x["start"], x["anchor"], x["more"], x["times"], x["crowded"], raw[x["start"] : x["start"] + x["more"] + length]))
            yield pd.DataFrame(out, columns=["key", "seg", "doc", "start", "anchor", "more", "times", "crowded", "bytes"])

    near = maybe_in(rows, F.col("doc"), hash_filter(wanted, F.col("doc")), "_asked").filter("_asked").drop("_asked")
    held = near.join(asked, "doc").mapInPandas(fetch, _ROWS + ", times long, crowded boolean, bytes binary").filter(F.octet_length("bytes") == F.col("more") + length)
    held = cut(held.dropDuplicates(["key", "seg"]))
    groups = held.filter("not crowded").select("key", "doc", "start", "more", "bytes")
    crowded = held.filter("crowded")
    if not crowded.isEmpty():
        # segments that occur again as they are are settled, but stay to be compared with: they count from here as two
        parts = cut(_split(crowded, length, 16))
        kinds, keys = _classified(parts.drop("bytes"), crowd)
        spans = spans.unionByName(_whole(parts, kinds, length))
        one = parts.join(kinds.join(keys.filter("kinds > 1"), "key").select("key", "seg", F.col("one.doc").alias("doc"), F.col("one.start").alias("start"), "crowded"), ["key", "seg", "doc", "start"])
        one = cut(one.dropDuplicates(["key", "seg"]))
        groups = groups.unionByName(one.filter("not crowded").select("key", "doc", "start", "more", "bytes"))
        single = cut(_split(one.filter("crowded"), length, 1).drop("bytes"))
        kinds, _ = _classified(single, crowd)
        spans = spans.unionByName(_whole(single, kinds, length))
    return spans.unionByName(_in_groups(groups, length))


def shared_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 240, anchor_bytes: int = 48) -> DataFrame:
    """doc and n_shared: bytes under anchors that are anchors of another document too; documents without any are left out.

    Every string of `least` bytes has an anchor (the least hash of its anchor_bytes-byte strings), so no passage of that
    length that two documents share goes unseen; what is counted is at least one anchor for each such passage.
    """
    short_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).filter("doc is not null")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, ids = list(batch["text"]), batch["doc"].to_numpy(np.int64)
            for a, b in blocks_of(texts, 1 << 20):
                got = segments(texts[a:b], least, anchor_bytes)
                yield pd.DataFrame({"key": got["key"], "doc": ids[a:b][got["of"]], "at": (got["start"] + got["anchor"]).astype(np.int32)})

    anchors = cut(rows.mapInPandas(scan, "key long, doc long, at int"))
    shared = anchors.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("key")
    near = maybe_in(anchors, F.col("key"), cut(hash_filter(shared, F.col("key"), _OPEN)), "_open", _OPEN).filter("_open").select("key", "doc", "at")
    # what the bitmap let pass in error is told by the documents of its own key
    sure = near.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("key")
    # a key may hold a third of all rows: documents are dealt over 16 places for each, with a copy of the key's one row
    salt = F.pmod(F.xxhash64("doc"), F.lit(16))
    sure = sure.withColumn("salt", F.explode(F.expr("sequence(0L, 15L)")))
    places = near.withColumn("salt", salt).join(sure, ["key", "salt"]).groupBy("doc").agg(F.array_sort(F.collect_set("at")).alias("at"))
    gaps = F.transform(F.slice("at", 2, F.size("at")), lambda x, k: F.least(F.lit(anchor_bytes), x - F.get("at", k)))
    return places.select("doc", F.aggregate(gaps, F.lit(anchor_bytes).cast("long"), lambda total, x: total + x).alias("n_shared"))


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, anchor_bytes: int = 32, crowd: int = 64) -> DataFrame:
    """One row per row of docs: id, n_bytes, n_removed, n_spans, kept (the remaining bytes, binary), n_shared.

    Texts are UTF-8 bytes, null is empty. A byte goes if a `length`-byte string over it also starts anywhere else, in
    the same text or another; matches overlap freely, stay inside one text and are judged on the input. n_spans counts
    maximal removed runs. Repeated rows are copies of each other; ids should name texts (rows with one id and different
    texts share their spans, cut to their length); rows with a null id lose nothing. Extra columns are ignored; no rows
    give no rows. n_shared (see shared_bytes) tells of shorter passages that other documents have too; nothing is removed for
    them. Texts without a span or a shared passage do not take part in the last shuffle.
    """
    spans = cut(repeated_spans(docs, id_col, text_col, length, anchor_bytes, crowd))
    merged = spans.groupBy("doc").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("spans"))
    merged = cut(merged.join(shared_bytes(docs, id_col, text_col), "doc", "full"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("_doc", F.col("id").cast("long"))
    rows = maybe_in(rows, F.col("_doc"), cut(hash_filter(merged, F.col("doc"))), "_hit")
    hit = rows.filter("_hit").join(merged, F.col("_doc") == F.col("doc"), "left").select("id", "text", "spans", "n_shared")
    rest = rows.filter("not _hit").select("id", "text", F.lit(None).cast("array<struct<a:bigint,b:bigint>>").alias("spans"), F.lit(None).cast("long").alias("n_shared"))

    @F.pandas_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    def removed(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for text, own in zip(texts, spans, strict=True):
            raw, left, at, runs = (text or "").encode("utf-8", "surrogatepass"), [], 0, 0
            end = -1  # of the run that is being removed
            for s in () if own is None else own:
                a, b = min(s["a"], len(raw)), min(s["b"], len(raw))
                if b <= max(at, a):
                    continue
                if a > end:
                    runs += 1
                left.append(raw[at : max(a, at)])
                at = end = b
            left.append(raw[at:])
            kept = b"".join(left)
            out.append((len(raw), len(raw) - len(kept), runs, kept))
        return pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept"])

    done = hit.unionByName(rest).select("id", removed("text", "spans").alias("r"), F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    return done.select(F.col("id").alias(id_col), "r.*", "n_shared")

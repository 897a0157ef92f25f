"""Compression of vectors to codes of a few codebook entries, with exact nearest entries by annular norm pruning.

A vector is cut into parts, each with a codebook that rounds of assignment and averaging improve. The nearest entry of a
part is found by norms: entries lie sorted by their norm, the distance to the best entry so far bounds how far the norm of
a nearer one can differ from the part's own, binary search gives the entries of that annulus, and only these are compared.
All components are integers, so that distances and averages are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut

_EXACT = 1 << 52  # integers up to here are exact as 64-bit floats, with one bit to spare


class AnnularIndex:
    """Entries of one codebook sorted by norm. nearest() gives exact nearest entries, ties to the lower index."""

    def __init__(self, entries: np.ndarray, probes: int = 32):
        self.entries = np.asarray(entries, np.int64)
        norms = np.sqrt((self.entries.astype(np.float64) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted, self.probes = norms[self.order], self.entries[self.order], probes

    def _distances(self, rows: np.ndarray, first: int, end: int) -> np.ndarray:
        """Squared distances of rows to the entries from place `first` to `end`, as int64."""
        some = self.sorted[first:end]
        most = int(max(np.abs(rows).max(initial=0), np.abs(some).max(initial=0)))
        if 4 * rows.shape[1] * most * most < _EXACT:  # products and sums are exact as floats, and floats multiply fast
            a, b = rows.astype(np.float64), some.astype(np.float64)
            return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
        return np.stack([((rows - e) ** 2).sum(1) for e in some], axis=1) if end > first else np.zeros((len(rows), 0), np.int64)

    def _better(self, best: np.ndarray, which: np.ndarray, rows: np.ndarray, first: int, end: int) -> None:
        """Take the entries of an interval into the best distances so far and the lowest index of those at this distance."""
        if end <= first:
            return
        away = self._distances(rows, first, end)
        least = away.min(1)
        index = np.where(away == least[:, None], self.order[first:end], len(self.order)).min(1)
        nearer = (least < best) | (least == best) & (index < which)
        best[nearer], which[nearer] = least[nearer], index[nearer]

    def nearest(self, rows: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry and squared distance for each row. Rows of close norms are handled together."""
        rows = np.asarray(rows, np.int64)
        own = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
        best, which = np.full(len(rows), np.iinfo(np.int64).max), np.full(len(rows), len(self.order), np.int64)
        by_norm = np.argsort(own, kind="stable")
        for k in range(0, len(rows), block):
            at = by_norm[k : k + block]
            part, norm, near, index = rows[at], own[at], best[at], which[at]
            # first the entries of like norm, whose best distance then bounds the annulus
            middle = int(np.searchsorted(self.norms, norm[len(at) // 2]))
            first = max(0, min(middle - self.probes // 2, len(self.norms) - self.probes))
            end = min(len(self.norms), first + self.probes)
            self._better(near, index, part, first, end)
            reach = np.sqrt(near.astype(np.float64))
            slack = 1e-9 * (norm + reach + self.norms[-1]) + 1e-9  # roots are rounded; a wider annulus is exact all the same
            low = int(np.searchsorted(self.norms, (norm - reach - slack).min(), "left"))
            high = int(np.searchsorted(self.norms, (norm + reach + slack).max(), "right"))
            self._better(near, index, part, low, min(high, first))
            self._better(near, index, part, max(low, end), high)
            best[at], which[at] = near, index
        return which, best


def _limit(width: int) -> int:
    """Components beyond this stand for this, so that a vector's error fits a long."""
    return int(((1 << 62) / max(width, 1)) ** 0.5) // 2


def _parts(column: pa.Array, width: int, parts: int, scale: int) -> np.ndarray:
    """Vectors of a batch as integers, rows by parts by components."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    limit = _limit(width)
    return np.clip(np.floor(flat * scale), -limit, limit).astype(np.int64).reshape(-1, parts, width // parts)


def _books(start: np.ndarray) -> list[AnnularIndex]:
    return [AnnularIndex(start[p]) for p in range(len(start))]


def usable(vectors: DataFrame, vec_col: str, parts: int) -> DataFrame:
    """Rows whose vector is not null, has finite components only, and a length that divides into parts."""
    own = F.col(vec_col)
    finite = F.forall(own, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(own.isNotNull() & (F.size(own) > 0) & (F.size(own) % parts == 0) & finite)


def encode_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", keep: tuple[str, ...] = (), parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[DataFrame, np.ndarray]:
    """Rows of id, the columns of keep, code (binary, a byte per part) and error (long); and the codebooks.

    Component x counts as floor(scale * x); beyond about 10^8 (for 64 components) as that bound. A part's codebook starts
    as that part of the `entries` vectors with the least ids (nulls last, ties by the vector); fewer vectors make it
    shorter. Each round assigns every part to its nearest entry, ties to the lower index, and replaces entries by the
    floor of their parts' mean; entries without parts stay. Vectors that cannot be coded go, see usable(), as do those of
    another length than the first one's. Repeated rows and ids are rows of their own; other columns are ignored; no rows
    give no rows and empty codebooks.

    A round is one scan: a task sums its own parts by entry, so a common vector costs no shuffle, and parts * entries
    sums come to the driver, as many for any input. The codebooks are broadcast, and nothing else is.
    """
    if entries > 256:
        raise ValueError("a code has one byte per part")
    spark = vectors.sparkSession
    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in vectors.columns))
    vec, ident = f"{free}vec", f"{free}id"
    rows = usable(vectors.select(F.col(id_col).alias(ident), F.col(vec_col).cast("array<double>").alias(vec), *keep), vec, parts)
    order = [F.col(ident).asc_nulls_last(), F.col(vec)]
    head = rows.select(ident, vec).orderBy(*order).limit(1).collect()
    width = len(head[0][1]) if head else 0
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{n}` {k}" for n, k in [(id_col, kinds[ident]), *[(c, kinds[c]) for c in keep], ("code", "binary"), ("error", "bigint")])
    if not width:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    rows = rows.filter(F.size(vec) == width)
    first = rows.select(ident, vec).orderBy(*order).limit(entries).collect()
    books = _parts(pa.array([r[1] for r in first], pa.list_(pa.float64())), width, parts, scale).transpose(1, 0, 2)
    inner = width // parts
    sums = [f"s{k}" for k in range(inner)]
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(books)

        def summed(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            start = sent.value
            index, n = _books(start), start.shape[1]
            count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, inner), np.int64)
            for batch in batches:
                own = _parts(batch.column(0), width, parts, scale)
                for p in range(parts):
                    which, _ = index[p].nearest(own[:, p])
                    by = np.argsort(which, kind="stable")
                    used, at = np.unique(which[by], return_index=True)
                    count[p] += np.bincount(which, minlength=n)
                    total[p, used] += np.add.reduceat(own[by, p], at, axis=0) if len(used) else 0
            p, e = np.nonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), *[pa.array(total[p, e, k]) for k in range(inner)]], names=["p", "e", "n", *sums])

        task = rows.select(vec).mapInArrow(summed, "p int, e int, n long, " + ", ".join(f"{s} long" for s in sums))
        books = books.copy()
        for r in task.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in sums]).collect():
            books[r["p"], r["e"]] = [int(r[s]) // r["n"] for s in sums]
    sent = spark.sparkContext.broadcast(books)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _books(sent.value)
        for batch in batches:
            own = _parts(batch.column(0), width, parts, scale)
            code, error = np.zeros((len(own), parts), np.uint8), np.zeros(len(own), np.int64)
            for p in range(parts):
                which, away = index[p].nearest(own[:, p])
                code[:, p] = which
                error += away
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], names=[id_col, *keep, "code", "error"])

    return rows.select(vec, ident, *keep).mapInArrow(coded, schema), books


def codebooks_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def with_totals(rows: DataFrame, key: str, value: str, name: str, share: int = 1000) -> DataFrame:
    """rows with the sum of value over rows of equal key, nulls together.

    Keys with more than a share-th of all rows are at most `share` and are broadcast with their totals, so that none of
    them is one task; the others are joined by key.
    """
    rows = cut(rows)
    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in rows.columns))
    kept, total, n = f"{free}k", f"{free}t", f"{free}n"
    totals = cut(rows.groupBy(F.col(key).alias(kept)).agg(F.sum(value).alias(total), F.count(F.lit(1)).alias(n)))
    all_rows = totals.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(totals.filter(F.col(n) * share > all_rows).select(kept, total))
    same = F.col(key).eqNullSafe(F.col(kept))
    rest = rows.join(hot, same, "left_anti").join(totals.filter(F.col(n) * share <= all_rows).select(kept, total), same)
    return rows.join(hot, same).unionByName(rest).withColumn(name, F.col(total)).select(*rows.columns, name)

"""Helpers shared by the training-data operators: checkpoints, bounded filters, byte-level word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.stages import materialised as cut  # noqa: F401
from quillspark.operators.stages import shared_folder as checkpoint_folder  # noqa: F401

#: Separators of words: space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def short_batches(spark: SparkSession, rows: int = 512) -> None:
    """Keep Arrow batches small: with texts of 100 KB and more, 10,000 rows would not fit a Python worker."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) != rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def bitmap_bits(n: int, least: int = 1 << 15, most: int = 1 << 27) -> int:
    """Bits of a bitmap for n keys: some eight each, so that it lets one in eight others pass, and no more than can be broadcast."""
    return max(least, min(most, 1 << (8 * max(n, 1) - 1).bit_length()))


def hash_filter(keys: DataFrame, key: Column, bits: int = 1 << 22) -> DataFrame:
    """A bitmap of fixed size over hashed keys: at most bits / 32768 rows of 1024 words of 32 bits, for any number of keys.

    It lets no key through unseen but may let others pass, so it only saves work ahead of an exact step.
    """
    slot = F.pmod(F.xxhash64(key), F.lit(bits))
    maps = keys.select(slot.alias("_slot")).groupBy(F.expr("_slot div 32768").alias("_bucket")).agg(F.bitmap_construct_agg(F.col("_slot") % 32768).alias("_bitmap"))
    return maps.select("_bucket", F.expr("transform(sequence(0, 1023), k -> cast(conv(hex(substring(_bitmap, k * 4 + 1, 4)), 16, 10) as bigint))").alias("_words"))


def maybe_in(rows: DataFrame, key: Column, bitmap: DataFrame, flag: str, bits: int = 1 << 22) -> DataFrame:
    """rows with a boolean column flag: false where key is certainly not among the keys of bitmap."""
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64(key), F.lit(bits))).withColumn("_bucket", F.expr("_slot div 32768"))
    rows = rows.join(F.broadcast(bitmap), "_bucket", "left")
    # bit p of the map is bit p % 8 of byte p div 8, and words hold their bytes from the left
    hit = F.expr("(shiftright(get(_words, cast((_slot % 32768) div 32 as int)), cast((3 - _slot % 32 div 8) * 8 + _slot % 8 as int)) & 1) = 1")
    return rows.withColumn(flag, F.coalesce(hit, F.lit(False))).drop("_slot", "_bucket", "_words")


# --- numpy over the bytes of many texts at once -------------------------------------------------------------------

_MIX = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        size = 1 << int(n - 1).bit_length()
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for k, base in enumerate((_BASE, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: close inputs give unrelated outputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def packed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, each followed by one newline, and where each text starts (one more entry at the end)."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join([*raw, b""]), np.uint8), starts


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in data, which must end with a separator."""
    gap = np.concatenate(([True], _SPACE[data]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """64-bit hashes of data[s:e] for each pair, from one running polynomial sum modulo 2**64."""
    up, down = powers(len(data) + 1)
    values = _MIX[_LOWERED[data]] if lower else _MIX[data]
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values * up[: len(data)], out=total[1:])
    return mixed((total[ends] - total[starts]) * down[starts] ^ (ends - starts).astype(np.uint64) << np.uint64(40))


def blocks_of(texts: list[str | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about `most` characters each; a longer text gets a range of its own."""
    first = total = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if total and total + n > most:
            yield first, i
            first, total = i, 0
        total += n
    if first < len(texts):
        yield first, len(texts)

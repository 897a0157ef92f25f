"""Exact dedup by progressive refinement: length, then hash of a prefix, then hash of the whole text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import ascii_lower, cut, hash_filter, maybe_in


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64, hash_all: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, n_bytes, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty; the largest id of equal texts stays.
    Lengths that occur once settle their documents at once; of the others, (length, prefix hash) pairs that occur once do.
    Only texts of surviving pairs are read in full and hashed; the rest have a null text_sha256 unless hash_all is set.
    A fixed-size bitmap carries the surviving pairs to the second scan, so no text is ever shuffled; its false hits end as
    groups of one. Repeated rows with one id and one text share a group and are all kept if their id is. Null ids stay
    rows; a group of null ids only has a null keep_id and is kept. Other columns of docs are ignored; no rows give no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.withColumn("_prefix", F.xxhash64(ascii_lower(F.substring("_text", 1, prefix_chars))))
    pairs = cut(rows.groupBy("n_bytes", "_prefix").agg(F.count(F.lit(1)).alias("_n")))
    lengths = pairs.groupBy("n_bytes").agg(F.sum("_n").alias("_same_length")).filter("_same_length > 1")
    survivors = pairs.join(lengths, "n_bytes", "left_semi").filter("_n > 1")
    key = F.struct("n_bytes", "_prefix")
    rows = maybe_in(rows, key, hash_filter(survivors, key), "_open")
    digest = F.sha2(ascii_lower(F.col("_text")), 256)
    rows = rows.withColumn("text_sha256", digest if hash_all else F.when(F.col("_open"), digest))
    settled = cut(rows.select("_id", "n_bytes", "_open", "text_sha256"))
    groups = settled.filter("_open").groupBy("n_bytes", "text_sha256").agg(F.max("_id").alias("_keep"), F.count(F.lit(1)).alias("_size")).filter("_size > 1")
    groups = cut(groups).select(F.col("n_bytes").alias("_gb"), F.col("text_sha256").alias("_gh"), "_keep", "_size")
    # a settled document can meet no group: the join key of its own spreads them evenly over the partitions
    settled = settled.withColumn("_key", F.when(F.col("_open"), F.col("text_sha256")).otherwise(F.concat(F.lit("#"), F.xxhash64("_id", "n_bytes"))))
    out = settled.join(groups, (F.col("_key") == F.col("_gh")) & (F.col("n_bytes") == F.col("_gb")), "left")
    keep = F.when(F.col("_size").isNull(), F.col("_id")).otherwise(F.col("_keep"))
    return out.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("_id")).alias("kept"),
        "n_bytes",
        "text_sha256",
    )

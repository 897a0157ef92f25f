"""Incremental sync by content hash, and the model catalogue's merge with protected overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def classify(current: DataFrame, ledger: DataFrame, key: str = "path") -> DataFrame:
    """key, status, hash: new, modified, unchanged or deleted, from the hashes of content and ledger."""
    now = current.select(key, F.sha2(F.coalesce("content", F.lit("")), 256).alias("hash"))
    both = now.join(ledger.select(key, F.col("hash").alias("old")), key, "full")
    status = F.when(F.col("old").isNull(), "new").when(F.col("hash").isNull(), "deleted").when(F.col("hash") != F.col("old"), "modified").otherwise("unchanged")
    return both.select(key, status.alias("status"), F.coalesce("hash", "old").alias("hash"))


def apply_sync(current: DataFrame, ledger: DataFrame, index: DataFrame, build, key: str = "path") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(index, ledger, changes): rows of changed and deleted sources go, those of new and changed ones are built."""
    changes = classify(current, ledger, key)
    stale = changes.filter(F.col("status").isin("modified", "deleted")).select(key)
    fresh = changes.filter(F.col("status").isin("new", "modified")).select(key)
    kept = index.join(stale, key, "left_anti")
    built = build(current.join(fresh, key, "left_semi"))
    return kept.unionByName(built), changes.filter("status <> 'deleted'").select(key, "hash"), changes


def tally(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def sync_catalog(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Merge by (provider, model_name): custom rows keep their type, and otherwise only chat becomes reasoning.

    Both sides: provider, model_name, model_type; existing also is_custom. Adds action: insert, update or keep.
    """
    old = existing.select("provider", "model_name", F.col("model_type").alias("old"), "is_custom")
    both = old.join(found.select("provider", "model_name", F.col("model_type").alias("new")), ["provider", "model_name"], "full")
    rises = ~F.coalesce("is_custom", F.lit(False)) & (F.col("old") == "chat") & (F.col("new") == "reasoning")
    kind = F.when(F.col("old").isNull(), F.col("new")).when(rises, "reasoning").otherwise(F.col("old"))
    action = F.when(F.col("old").isNull(), "insert").when(rises, "update").otherwise("keep")
    return both.select("provider", "model_name", kind.alias("model_type"), F.coalesce("is_custom", F.lit(False)).alias("is_custom"), action.alias("action"))


def sync_templates(existing: DataFrame, found: DataFrame, key: str = "tool_type", owned: tuple[str, ...] = ("is_active",)) -> DataFrame:
    """Upsert by key: found rows replace existing ones but for the columns in owned, new ones are active; the rest stays.

    Adds action: insert, update or keep. A key that is found more than once counts by its greatest row.
    """
    columns = [c for c in found.columns if c != key]
    new = found.groupBy(key).agg(F.max(F.struct(*columns)).alias("_new"))
    both = existing.select(key, F.struct(*[c for c in existing.columns if c != key]).alias("_old")).join(new, key, "full")
    taken = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(f"_old.{c}")).alias(c) for c in columns]
    kept = [F.coalesce(F.col(f"_old.{c}"), F.lit(True)).alias(c) for c in owned]
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNotNull(), "update").otherwise("keep")
    return both.select(key, *taken, *kept, action.alias("action"))

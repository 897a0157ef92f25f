"""Relational building blocks: optional filters, pages, set differences, statistics views, upserts and deletes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def optional_filters(rows: DataFrame, equal: Mapping[str, object] | None = None, within: Mapping[str, Sequence[object]] | None = None, search: str | None = None, search_in: Sequence[str] = ()) -> DataFrame:
    """Only the conditions that are given; search is a substring in any of the columns, % and _ keep their meaning."""
    for name, value in (equal or {}).items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    for name, values in (within or {}).items():
        if values is not None:
            rows = rows.filter(F.col(name).isin(*values))
    if search and search_in:
        rows = rows.filter(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{search}%") for c in search_in]))
    return rows


def page(rows: DataFrame, order: Sequence[Column | str], skip: int = 0, limit: int = 50) -> DataFrame:
    """One page in a total order: the order must end in a unique key."""
    if skip < 0 or not 1 <= limit <= 100:
        raise ValueError("skip must be 0 or more and limit from 1 to 100")
    return rows.orderBy(*order).offset(skip).limit(limit)


def list_with_counts(parents: DataFrame, children: DataFrame, key: str, stamp: str) -> DataFrame:
    """Parents with the number of their children and the last stamp; children are aggregated before the join."""
    counted = children.groupBy(key).agg(F.count(F.lit(1)).alias("n_children"), F.max(stamp).alias("last_stamp"))
    return parents.join(counted, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def first_of_each(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First occurrence wins: one row per key in the order given."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """rows replace those of table with the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def delete_by(table: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return table.join(ids.select(key).distinct(), key, "left_anti")


def merge_json(old: Column, new: Column) -> Column:
    """The union of two flat JSON objects as a map; the right side wins."""
    a, b = (F.from_json(c, "map<string,string>") for c in (old, new))
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)


def tallies(rows: DataFrame, tests: Mapping[str, Column], total: str = "total") -> DataFrame:
    """One row: how many rows there are, and for how many each test holds."""
    return rows.agg(F.count(F.lit(1)).alias(total), *[F.count_if(test).alias(name) for name, test in tests.items()])


def copy_name(name: str, taken: DataFrame, name_col: str) -> DataFrame:
    """The first free name of the form `name (Copy)`, `name (Copy 2)`, ..."""
    spark = taken.sparkSession
    n = F.col("n")
    wish = F.when(n == 1, F.lit(f"{name} (Copy)")).otherwise(F.concat(F.lit(f"{name} (Copy "), n.cast("string"), F.lit(")")))
    used = taken.filter(F.col(name_col).startswith(name))
    limit = used.count() + 2
    wishes = spark.range(1, limit + 1).withColumnRenamed("id", "n").select("n", wish.alias("name"))
    return wishes.join(used.select(F.col(name_col).alias("name")).distinct(), "name", "left_anti").orderBy("n").limit(1).select("name")

"""Keyed changes of tables, as new tables: nothing is changed in place.

A null key matches nothing: such rows are kept on the old side, and all come in on the new one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.operators.fusion import first_of_each


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in ``order``."""
    return first_of_each(rows, keys, order)


def _one_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; rows with a null in the key are all kept."""
    known = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return first_of_each(rows.where(known), keys, order).unionByName(rows.where(~known))


def upserted(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The old rows whose key isn't new, and the new ones. Of new rows with one key the first in ``order`` counts, by
    default the greatest in all columns."""
    fresh = _one_each(new.select(*old.columns), keys, order or [F.col(c).desc() for c in old.columns])
    return old.join(fresh.select(*keys), keys, "left_anti").select(*old.columns).unionByName(fresh)


def added(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """The old rows, and the new ones whose key isn't there yet. Of new rows with one key the first in ``order`` comes
    in, by default the least in all columns."""
    fresh = _one_each(new.select(*old.columns), keys, order or [F.col(c).asc() for c in old.columns])
    return old.unionByName(fresh.join(old.select(*keys).distinct(), keys, "left_anti").select(*old.columns))


def removed(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows without those whose key is in ``gone``."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti").select(*rows.columns)


def filled(old: DataFrame, new: DataFrame, key: str, kept_if_blank: list[str], untouched: list[str]) -> DataFrame:
    """An upsert of whole records in which some columns keep their old value: those of ``kept_if_blank`` where the new
    one is blank, those of ``untouched`` wherever there is an old record."""
    def column(c: str) -> Column:
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        both = F.col("a.__there") & F.col("b.__there")
        if c in untouched:
            value = F.when(both, a).otherwise(F.coalesce(b, a))
        elif c in kept_if_blank:
            value = F.when(both & (F.coalesce(F.trim(b), F.lit("")) == ""), a).when(F.col("b.__there"), b).otherwise(a)
        else:
            value = F.when(F.col("b.__there"), b).otherwise(a)
        return value.alias(c)

    columns = [c for c in old.columns if c != key]
    a = old.withColumn("__there", F.lit(True)).alias("a")
    b = new.select(*(c if c in new.columns else F.lit(None).cast(dict(old.dtypes)[c]).alias(c) for c in old.columns)).withColumn("__there", F.lit(True)).alias("b")
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full").select(F.coalesce(F.col(f"a.{key}"), F.col(f"b.{key}")).alias(key), *map(column, columns))


def write_by(rows: DataFrame, path: str, partition: str) -> None:
    """Replaces the partitions that ``rows`` has rows of, and no others. One writer at a time."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)

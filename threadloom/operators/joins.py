"""Lookups, snapshot differences and keyed rewrites."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Keys = str | Sequence[str]


def allow(df: DataFrame, allowed: DataFrame, on: Keys) -> DataFrame:
    """Rows whose key is allowed; a key that is allowed twice keeps a row once."""
    return df.join(allowed.select(on) if isinstance(on, str) else allowed.select(*on), on, "left_semi")


def deny(df: DataFrame, denied: DataFrame, on: Keys) -> DataFrame:
    return df.join(denied.select(on) if isinstance(on, str) else denied.select(*on), on, "left_anti")


def flagged_without(allowed: DataFrame, flag: Column, domain: Column, excluded: DataFrame) -> DataFrame:
    """Flagged rows whose domain is not excluded (column domain of excluded)."""
    return allowed.where(flag).withColumn("__d", F.lower(domain)).join(excluded.select(F.lower("domain").alias("__d")), "__d", "left_anti").drop("__d")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, fingerprint: str, unchanged: bool = False) -> DataFrame:
    """(key, op, old_fingerprint, new_fingerprint): op is added, changed, removed or, if asked for, unchanged."""
    a = old.select(key, F.col(fingerprint).alias("old_fingerprint"), F.lit(True).alias("__o"))
    b = new.select(key, F.col(fingerprint).alias("new_fingerprint"), F.lit(True).alias("__n"))
    op = F.when(F.col("__o").isNull(), "added").when(F.col("__n").isNull(), "removed").when(~F.col("old_fingerprint").eqNullSafe(F.col("new_fingerprint")), "changed").otherwise("unchanged")
    out = a.join(b, key, "full_outer").select(key, op.alias("op"), "old_fingerprint", "new_fingerprint")
    return out if unchanged else out.where("op <> 'unchanged'")


def to_upsert(diff: DataFrame) -> DataFrame:
    return diff.where(F.col("op").isin("added", "changed"))


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with the rows of changes in place of those of the same key."""
    return target.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def replace_entries(current: DataFrame, removed: DataFrame, added: DataFrame, key: str) -> DataFrame:
    return delete_keys(current, removed, key).unionByName(added, allowMissingColumns=True)


def orphans(existing: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Distinct keys that exist and are not expected."""
    return existing.select(key).distinct().join(expected.select(key), key, "left_anti")


def sync_missing(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """target and the rows of source that it lacks."""
    return target.unionByName(source.join(target.select(key), key, "left_anti"), allowMissingColumns=True)


def pending(rows: DataFrame, done: DataFrame, key: str, failed: Column | None = None) -> DataFrame:
    """Rows whose normalised key is not done; failed rows of done count as open."""
    ok = done if failed is None else done.where(~F.coalesce(failed, F.lit(False)))
    norm = lambda c: F.lower(F.trim(F.col(c)))
    return rows.withColumn("__k", norm(key)).join(ok.select(norm(key).alias("__k")).distinct(), "__k", "left_anti").drop("__k")


def lookup(df: DataFrame, dimension: DataFrame, on: str, value: str, out: str, default: Column | None = None) -> DataFrame:
    """df with the dimension's value, or the default (the key itself) where it has none; the dimension's keys are made unique."""
    unique = dimension.groupBy(on).agg(F.min(value).alias("__v"))
    return df.join(unique, on, "left").withColumn(out, F.coalesce("__v", F.col(on).cast("string") if default is None else default)).drop("__v")


def overlay(base: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """base with the columns of changes where it has a row of the key with a value."""
    new = changes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    return base.join(new, key, "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop(*[f"__{c}" for c in columns])


def in_given_order(rows: DataFrame, wanted: DataFrame, key: str, place: str) -> DataFrame:
    """The rows of the wanted keys with their place; unknown keys are left out."""
    return rows.join(wanted.select(key, place), key)


def distinct_ids(rows: DataFrame, nested: str, field: str) -> DataFrame:
    """The distinct ids inside an array of structs, in order."""
    return rows.select(F.explode(nested).alias("__x")).select(F.col(f"__x.{field}").alias(field)).where(F.col(field).isNotNull()).distinct()


def first_wins(df: DataFrame, key: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each key, by an aggregate that starts before the shuffle; an empty key is no key and must be replaced by the caller."""
    first = df.groupBy(key.alias("__key")).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("__row"))
    return first.select("__row.*")


def message_key(message_id: Column, sender: Column, date: Column, body: Column, prefix: int = 120) -> Column:
    """A message's id, or who, when and how it begins where it has none."""
    t = F.coalesce(F.trim(message_id), F.lit(""))
    return F.when(t != "", F.concat(F.lit("id:"), t)).otherwise(F.concat_ws("\x1f", F.lit("by:"), F.coalesce(sender, F.lit("")), F.coalesce(date, F.lit("")), F.substring(F.coalesce(body, F.lit("")), 1, prefix)))

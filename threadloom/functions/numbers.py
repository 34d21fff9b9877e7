"""Percentiles, medians, dates, identifiers and vectors as Column builders."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def nearest_rank(q: float):
    """The place (from 0) of a percentile among n sorted values: round-half-even(q (n - 1)); for ranking.order_statistics."""
    return lambda n: F.bround(q * (n - 1)).cast("long")


def floor_rank(q: float = 0.95):
    """The place (from 0) max(0, floor(q n) - 1); for ranking.order_statistics."""
    return lambda n: F.greatest(F.lit(0), F.floor(q * n) - 1)


def median_or_zero(values: Column) -> Column:
    return F.coalesce(F.median(values), F.lit(0.0))


def mail_date(c: Column) -> Column:
    """An RFC 2822 date as a timestamp, null if it can't be read; without a zone it counts as UTC."""
    t = F.regexp_replace(F.regexp_replace(F.trim(c), r"^\w{3},\s*", ""), r"\s*\(.*\)$", "")
    t = F.regexp_replace(t, r"\s+", " ")
    zoned = [F.try_to_timestamp(t, F.lit(p)) for p in ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z")]
    naive = F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(*zoned, naive)


def uuid5(name: Column, namespace: uuid.UUID = uuid.NAMESPACE_URL) -> Column:
    """RFC 4122 version 5 by SHA-1."""
    s = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(s, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)))
    part = lambda a, n: F.substring(s, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(F.lpad(variant, 2, "0"), part(19, 2)), part(21, 12))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a side is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def hashed_vector(words: Column, dim: int = 256) -> Column:
    """Counts of words hashed by MD5 into dim places (a power of 16 at most 65536), of unit length."""
    digits = len(f"{dim - 1:x}")
    if 16**digits != dim:
        raise ValueError("dim must be a power of 16")
    places = F.transform(words, lambda w: F.conv(F.right(F.md5(w.cast("binary")), F.lit(digits)), 16, 10).cast("int"))

    def counts(held: Column) -> Column:
        # a map of the places that occur, looked up once a place
        distinct = F.array_distinct(held)
        by_place = F.map_from_arrays(distinct, F.transform(distinct, lambda d: F.size(F.filter(held, lambda p: p == d)).cast("double")))
        return F.transform(F.array(by_place), lambda m: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))[0]

    # transforms over one element, so that places and counts are made once
    counted = F.transform(F.array(places), counts)
    scaled = F.transform(counted, lambda v: F.transform(F.array(F.sqrt(F.aggregate(v, F.lit(0.0), lambda t, x: t + x * x))), lambda size: F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v))[0])
    return scaled[0]

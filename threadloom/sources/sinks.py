"""Sinks: distributed writes sorted within partitions; small summaries are rendered on the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import truncated


def sorted_json(df: DataFrame, path: str, keys: Sequence[str], mode: str = "overwrite") -> None:
    """JSON lines in the order of keys across files, by range partitions."""
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).json(path)


def sorted_csv(df: DataFrame, path: str, *order: Column | str, sep: str = ",", mode: str = "overwrite") -> None:
    df.orderBy(*order).write.mode(mode).option("header", True).option("escape", '"').option("sep", sep).csv(path)


def thread_files(messages: DataFrame, path: str, thread: str = "thread", order: str = "seq", rule: str = "=" * 78) -> None:
    """A text file a thread, in a folder named by it; one thread's text is one value."""
    block = F.concat(F.lit(rule + "\n["), F.upper("role"), F.lit("]\n" + "-" * 78 + "\n"), F.coalesce("text", F.lit("")), F.lit("\n"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), block.alias("b")))), lambda x: x["b"]), "\n")
    messages.groupBy(thread).agg(joined.alias("value")).write.mode("overwrite").partitionBy(thread).text(path)


def rewrite_text(df: DataFrame, value: Column, path: str, by: str | None = None) -> None:
    w = df.select(value.alias("value"), *([by] if by else [])).write.mode("overwrite")
    (w.partitionBy(by) if by else w).text(path)


def corpus(exchanges: DataFrame, tree: str, flat: str, least_words: int) -> None:
    """Exchanges as a folder of JSON a thread and as flat JSON lines, those under the least words left out of the latter."""
    exchanges.write.mode("overwrite").partitionBy("thread").json(tree)
    exchanges.where(F.col("word_count") >= least_words).write.mode("overwrite").json(flat)


def file_corpus(files: DataFrame, path: str) -> None:
    """A chunk a file that has a text."""
    files.where(F.trim("text") != "").write.mode("overwrite").json(path)


def manifest(entries: DataFrame, path: str) -> None:
    entries.orderBy("chunk_id").coalesce(1).write.mode("overwrite").json(path)


def points(df: DataFrame, path: str, recreate: bool = False, by: str = "source") -> None:
    """A table of points, partitioned so that a filter on by prunes; an existing one is only replaced if told to."""
    df.write.mode("overwrite" if recreate else "errorifexists").partitionBy(by).parquet(path)


def copied(source: DataFrame, path: str) -> int:
    """A full copy whose count is checked."""
    source.write.mode("errorifexists").parquet(path)
    n, m = source.count(), source.sparkSession.read.parquet(path).count()
    if n != m:
        raise ValueError(f"copied {m} of {n} rows")
    return n


def catalog_csv(clusters: DataFrame, path: str, variants: int = 5, original: int = 800) -> None:
    """A catalog for people: the first variants joined, originals cut."""
    shown = clusters.withColumns({"variants": F.array_join(F.slice("variants", 1, variants), " | "), "question_original": F.substring("question_original", 1, original)})
    sorted_csv(shown, path, F.col("frequency").desc(), "question", sep=";")


def count_manifest(df: DataFrame, key: str, path: str) -> None:
    """Lines of count, tab and key, most first."""
    counts = df.groupBy(F.lower(key).alias("k")).count().orderBy(F.col("count").desc(), "k")
    counts.select(F.concat_ws("\t", F.col("count").cast("string"), "k").alias("value")).write.mode("overwrite").text(path)


def append_csv(df: DataFrame, path: str, most: int = 49_000) -> None:
    """Rows added to a CSV table, cells cut to a sheet's limit."""
    cells = [truncated(F.col(c), most).alias(c) if kind == "string" else F.col(c) for c, kind in df.dtypes]
    df.select(*cells).write.mode("append").option("header", True).option("escape", '"').csv(path)


def contexts(df: DataFrame, key: str, path: str) -> None:
    """One JSON document a key."""
    df.select(key, F.to_json(F.struct(*[c for c in df.columns if c != key])).alias("value")).write.mode("overwrite").partitionBy(key).text(path)


def readable(df: DataFrame, path: str) -> None:
    """A text dump, a block a row of named values."""
    parts = [F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in df.columns]
    df.select(F.concat_ws("\n", *parts, F.lit("-" * 40)).alias("value")).write.mode("overwrite").text(path)


def lowest(df: DataFrame, score: str, n: int, path: str) -> None:
    df.orderBy(score).limit(n).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def daily(df: DataFrame, day: Column, path: str) -> None:
    """Rows by day; dropping a day's folder is the retention."""
    df.withColumn("day", day).write.mode("append").partitionBy("day").parquet(path)


def markdown_table(df: DataFrame, most: int = 100) -> str:
    """A small result as a Markdown table; more rows than most are an error, so nothing large reaches the driver."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def stats_json(stats: dict[str, DataFrame], most: int = 100) -> str:
    """Small results by name as one JSON document; more rows than most of any are an error."""
    rows = {k: df.limit(most + 1).collect() for k, df in stats.items()}
    if large := [k for k, found in rows.items() if len(found) > most]:
        raise ValueError(f"more than {most} rows: {', '.join(large)}")
    return json.dumps({k: [r.asDict(recursive=True) for r in found] for k, found in rows.items()}, default=str, ensure_ascii=False, indent=2)

"""Messages in order: exchanges, replies, latencies, sessions and funnels.

A thread's messages have columns thread, seq, role, text and, for timed operators, ts; other names are passed in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLIENT, MANAGER = "client", "manager"


def by_thread(thread: str = "thread", *order: str):
    return Window.partitionBy(thread).orderBy(*(order or ("seq",)))


def with_exchange(df: DataFrame, thread: str = "thread", seq: str = "seq", role: Column | None = None, broken: Column | None = None) -> DataFrame:
    """df with exchange (from 1): a new one begins where a client follows a manager, or where broken is true.

    Exact where a row of another role stands alone before the thread's first client; folded() is for the rest."""
    r = F.col("role") if role is None else role
    w = by_thread(thread, seq)
    starts = (r == CLIENT) & (F.lag(r).over(w) == MANAGER)
    starts = F.coalesce(starts, F.lit(False)) | (F.coalesce(broken, F.lit(False)) if broken is not None else F.lit(False))
    return df.withColumn("__b", starts.cast("int")).withColumn("exchange", (F.sum("__b").over(w) + 1).cast("long")).drop("__b")


def folded(df: DataFrame, thread: str = "thread", seq: str = "seq") -> DataFrame:
    """(thread, seq, role, exchange, side): a row of unknown role joins the side that is open.

    After any manager row the open side is the manager's; a client row there begins an exchange. A row of another role
    counts as the manager's once the exchange has a client row, else as the client's without being one. So a client row begins an
    exchange where a row of another role stands between it and the client row before, or, for the first one, where a manager row does."""
    w = by_thread(thread, seq)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    is_ = lambda role: F.coalesce(F.col("role") == role, F.lit(False))
    seen = lambda role: F.coalesce(F.max(is_(role)).over(before), F.lit(False))
    rows = df.select(thread, F.col(seq).cast("long").alias(seq), "role", F.lag(is_(CLIENT)).over(w).alias("__last"), seen(CLIENT).alias("__c"), seen(MANAGER).alias("__m"))
    begins = F.col("__last").isNull() | (is_(CLIENT) & F.when(F.col("__c"), ~F.col("__last")).otherwise(F.col("__m")))
    numbered = rows.withColumn("exchange", F.sum(begins.cast("int")).over(w).cast("int"))
    opened = F.max(is_(CLIENT)).over(Window.partitionBy(thread, "exchange").orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    side = F.when(is_(CLIENT), CLIENT).when(is_(MANAGER) | opened, MANAGER).otherwise(CLIENT)
    return numbered.select(thread, seq, "role", "exchange", side.alias("side"))


def exchanges(df: DataFrame, thread: str = "thread", seq: str = "seq", client_first: bool = True) -> DataFrame:
    """One row an exchange of rows with exchange: its span, counts, and text, a client's parts first or all as they came."""
    side = F.when(F.col("role") == CLIENT, 0).otherwise(1)
    part = F.struct((side if client_first else F.lit(0)).alias("side"), F.col(seq).alias("seq"), F.coalesce("text", F.lit("")).alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "\n\n")
    return df.groupBy(thread, "exchange").agg(
        F.min(seq).alias("first_seq"),
        F.max(seq).alias("last_seq"),
        F.count_if(F.col("role") == CLIENT).alias("client_messages"),
        F.count_if(F.col("role") == MANAGER).alias("manager_messages"),
        joined.alias("text"),
    )


def exchange_id(thread: Column, exchange: Column) -> Column:
    n = exchange.cast("string")
    return F.concat(thread.cast("string"), F.lit("__ex"), F.when(F.length(n) >= 3, n).otherwise(F.lpad(n, 3, "0")))


def gap_sessions(df: DataFrame, key: str, ts: str, seconds: int, order: str | None = None) -> DataFrame:
    """df with session (from 1): a new one begins after a pause longer than seconds."""
    w = by_thread(key, ts, *([order] if order else []))
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))
    return df.withColumn("__b", F.coalesce((gap > seconds * 1_000_000).cast("int"), F.lit(0))).withColumn("session", (F.sum("__b").over(w) + 1).cast("long")).drop("__b")


def chat_exchanges(df: DataFrame, chat: str = "chat", ts: str = "ts", seq: str = "seq", seconds: int = 48 * 3600) -> DataFrame:
    """df with exchange: broken by pauses longer than seconds as well as by a client after a manager."""
    w = by_thread(chat, seq)
    pause = F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w)) > seconds * 1_000_000
    return with_exchange(df, chat, seq, broken=pause)


def reply_latency(df: DataFrame, thread: str, order: list[str], role: str, ts: str, asking: str, replying: str, most_seconds: int = 30 * 86400) -> DataFrame:
    """Rows where a reply follows directly on a question, with latency_s above zero and at most the limit."""
    w = by_thread(thread, *order)
    out = df.withColumn("__r", F.lag(role).over(w)).withColumn("latency_s", (F.unix_micros(F.col(ts)) - F.unix_micros(F.lag(ts).over(w))) / 1e6)
    return out.where((F.col(role) == replying) & (F.col("__r") == asking) & (F.col("latency_s") > 0) & (F.col("latency_s") <= most_seconds)).drop("__r")


def next_replies(df: DataFrame, thread: str, seq: str, role: str, value: str, asking: str, replying: str, most: int = 4) -> DataFrame:
    """Each asking row with the values of the next replying rows of its thread, at most so many: by ordinals, without a pair of all rows."""
    w = by_thread(thread, seq)
    n = df.withColumn("__n", F.sum((F.col(role) == replying).cast("int")).over(w))
    asked = n.where(F.col(role) == asking).select(thread, F.col(seq).alias("ask_seq"), "__n").withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(most)))).withColumn("__n", F.col("__n") + F.col("__k"))
    replies = n.where(F.col(role) == replying).select(thread, "__n", F.col(seq).alias("reply_seq"), F.col(value).alias("reply"))
    return asked.join(replies, [thread, "__n"]).select(thread, "ask_seq", F.col("__k").alias("nth"), "reply_seq", "reply")


def first_reply_after(df: DataFrame, thread: str, ts: str, role: str, asking: str, replying: str) -> DataFrame:
    """(thread, first_ask, first_reply): the first reply not before the first question."""
    asked = df.groupBy(thread).agg(F.min(F.when(F.col(role) == asking, F.col(ts))).alias("first_ask"))
    named = asked.select(F.col(thread).alias("__t"), "first_ask")
    replies = df.where(F.col(role) == replying).join(named, F.col(thread).eqNullSafe(F.col("__t"))).where(F.col(ts) >= F.col("first_ask"))
    first = replies.groupBy(F.col("__t")).agg(F.min(ts).alias("first_reply"))
    return named.join(first.withColumnRenamed("__t", "__u"), F.col("__t").eqNullSafe(F.col("__u")), "left").select(F.col("__t").alias(thread), "first_ask", "first_reply")


def days_to_first(df: DataFrame, thread: str, ts: str, order: list[str], hit: Column) -> DataFrame:
    """(thread, days) from the first dated row to the first row, in thread order, that is a hit."""
    place = F.struct(*order)
    out = df.groupBy(thread).agg(F.min(ts).alias("__first"), F.min_by(F.col(ts), F.when(hit, place)).alias("__hit"), F.count_if(hit).alias("__n"))
    return out.where("__n > 0 and __hit is not null").select(thread, ((F.unix_micros("__hit") - F.unix_micros("__first")) / 86_400e6).alias("days"))


def spans(df: DataFrame, thread: str, ts: str) -> DataFrame:
    """(thread, n, span_s): span is null with fewer than two dated rows."""
    span = (F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / 1e6
    return df.groupBy(thread).agg(F.count("*").alias("n"), F.when(F.count(ts) >= 2, span).alias("span_s"))


def first_dated(df: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """The earliest row of each key; a row without a date only where none is dated."""
    w = Window.partitionBy(key).orderBy(F.col(ts).isNull(), ts, order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")

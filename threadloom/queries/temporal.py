"""Exchanges, latencies, sessions, funnels and percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import numbers, text
from ..operators import ranking, threads
from .registry import MESSAGES, Tables, messages, query

EXCHANGES = f"""{MESSAGES}, marked AS (
  SELECT *, (role = 'client' AND coalesce(lag(role) OVER w, '') = 'manager')::INT AS b FROM messages WINDOW w AS (PARTITION BY thread ORDER BY seq)
), numbered AS (SELECT *, sum(b) OVER (PARTITION BY thread ORDER BY seq) + 1 AS exchange FROM marked)"""

# events as messages of a user's thread: views ask, clicks reply
SIDED = """sided AS (SELECT *, CASE event_type WHEN 'view' THEN 'in' WHEN 'click' THEN 'out' ELSE 'other' END AS side FROM events)"""


def sided(t: Tables) -> DataFrame:
    side = F.when(F.col("event_type") == "view", "in").when(F.col("event_type") == "click", "out").otherwise("other")
    return t.events.withColumn("side", side)


@query(f"""WITH {EXCHANGES}
SELECT thread || '__ex' || CASE WHEN exchange < 1000 THEN lpad(exchange::VARCHAR, 3, '0') ELSE exchange::VARCHAR END AS exchange_id, min(seq) AS first_seq, max(seq) AS last_seq,
  count(*) FILTER (WHERE role = 'client') AS client_messages, count(*) FILTER (WHERE role = 'manager') AS manager_messages,
  md5(string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY CASE role WHEN 'client' THEN 0 ELSE 1 END, seq)) AS text_md5
FROM numbered GROUP BY thread, exchange""")
def exchange_segments(t: Tables) -> DataFrame:
    """Conversations cut into exchanges, a client's parts before the manager's (rows W1, W8)."""
    made = threads.exchanges(threads.with_exchange(messages(t)))
    return made.select(threads.exchange_id(F.col("thread"), F.col("exchange")).alias("exchange_id"), "first_seq", "last_seq", "client_messages", "manager_messages", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {EXCHANGES} SELECT thread, count(DISTINCT exchange) AS exchanges FROM numbered GROUP BY thread""")
def exchange_fold(t: Tables) -> DataFrame:
    """The same exchanges by an ordered fold, which also holds for unknown roles anywhere."""
    return threads.folded(messages(t)).groupBy("thread").agg(F.countDistinct("exchange").alias("exchanges"))


@query("""WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) + 1 AS session FROM e)
SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS events, min(event_id) AS first_event, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS BIGINT) AS seconds FROM n GROUP BY ALL""")
def gap_sessions(t: Tables) -> DataFrame:
    """Sessions broken by pauses of more than 48 hours (rows W2, T13)."""
    made = threads.gap_sessions(t.events, "user_id", "ts", 48 * 3600, "event_id")
    seconds = F.expr("(unix_micros(max(ts)) - unix_micros(min(ts))) div 1000000")
    return made.groupBy("user_id", "session").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"), seconds.alias("seconds"))


@query("""WITH e AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000 THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
n AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM e)
SELECT user_id, min(ts) AS begin_ts, count(*) AS events FROM n GROUP BY user_id, session""")
def session_window_batch(t: Tables) -> DataFrame:
    """The same by the built-in session window, as a stream would run it."""
    events = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events.groupBy("user_id", F.session_window("ts", "48 hours")).agg(F.min("ts").alias("begin_ts"), F.count("*").alias("events")).select("user_id", F.col("begin_ts").cast("timestamp_ntz").alias("begin_ts"), "events")


@query(f"""WITH {SIDED}, m AS (
  SELECT user_id AS thread, row_number() OVER w AS seq, ts, CASE side WHEN 'in' THEN 'client' WHEN 'out' THEN 'manager' ELSE 'unknown' END AS role FROM sided WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
), b AS (SELECT *, (role = 'client' AND coalesce(lag(role) OVER w, '') = 'manager' OR coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER w) > 172800000000, false))::INT AS b FROM m WINDOW w AS (PARTITION BY thread ORDER BY seq)),
n AS (SELECT *, sum(b) OVER (PARTITION BY thread ORDER BY seq) + 1 AS exchange FROM b)
SELECT thread, count(DISTINCT exchange) AS exchanges, max(exchange)::BIGINT AS last_exchange FROM n GROUP BY thread""")
def chat_exchanges(t: Tables) -> DataFrame:
    """Exchanges of a timed chat: a pause or a client after a manager breaks (row W2)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    role = F.when(F.col("side") == "in", "client").when(F.col("side") == "out", "manager").otherwise("unknown")
    m = sided(t).select(F.col("user_id").alias("thread"), F.row_number().over(w).alias("seq"), "ts", role.alias("role"))
    return threads.chat_exchanges(m, chat="thread").groupBy("thread").agg(F.countDistinct("exchange").alias("exchanges"), F.max("exchange").alias("last_exchange"))


@query(f"""WITH {SIDED}, l AS (SELECT *, lag(side) OVER w AS before, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS s FROM sided WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT user_id % 10 AS account, s FROM l WHERE side = 'out' AND before = 'in' AND s > 0 AND s <= 2592000)
SELECT account, count(*) AS n, round(median(s / 3600), 4) AS median_h, round(avg(s / 3600), 4) AS mean_h,
  round(list_sort(list(s / 3600))[round_even(0.9 * (count(*) - 1), 0)::INT + 1], 4) AS p90_h, round_even(100.0 * count(*) FILTER (WHERE s <= 86400) / count(*), 1) AS within_day_pct
FROM k GROUP BY account""")
def reply_latency(t: Tables) -> DataFrame:
    """Latency of direct replies by account: count, median, mean, nearest-rank p90, share within a day (rows W3, J9, A10-A13)."""
    hours = F.col("latency_s") / 3600
    out = threads.reply_latency(sided(t), "user_id", ["ts", "event_id"], "side", "ts", "in", "out").withColumn("account", F.col("user_id") % 10)
    out = out.select("account", "latency_s", hours.alias("hours"))
    means = out.groupBy("account").agg(F.round(F.avg("hours"), 4).alias("mean_h"), F.bround(100.0 * F.count_if(F.col("latency_s") <= 86400) / F.count("*"), 1).alias("within_day_pct"))
    middle = lambda up: lambda n: F.floor((n - 1 + up) / 2)
    ranks = ranking.order_statistics(out, ["account"], "hours", {"low": middle(0), "high": middle(1), "p90": numbers.nearest_rank(0.9)})
    median = F.round((F.col("low") + F.col("high")) / 2, 4)
    named = ranks.select(F.col("account").alias("__a"), "n", median.alias("median_h"), F.round("p90", 4).alias("p90_h"))
    return means.join(named, F.col("account").eqNullSafe(F.col("__a"))).drop("__a")


@query(f"""WITH {SIDED}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, side, value FROM sided),
c AS (SELECT *, sum((side = 'out')::INT) OVER (PARTITION BY user_id ORDER BY seq) AS n FROM r)
SELECT a.user_id, a.seq AS ask_seq, CAST(b.n - a.n AS INT) AS nth, b.seq AS reply_seq, b.value AS reply
FROM c a JOIN c b ON a.user_id = b.user_id AND a.side = 'in' AND b.side = 'out' AND b.n BETWEEN a.n + 1 AND a.n + 4""")
def next_replies(t: Tables) -> DataFrame:
    """Each question with the next four replies of its thread (row J8)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return threads.next_replies(sided(t).withColumn("seq", F.row_number().over(w).cast("long")), "user_id", "seq", "side", "value", "in", "out", 4)


@query(f"""WITH {SIDED}, r AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, side, value FROM sided),
c AS (SELECT *, sum((side = 'out')::INT) OVER (PARTITION BY user_id ORDER BY seq) AS n FROM r),
p AS (SELECT a.user_id, a.seq AS ask_seq, b.seq AS reply_seq, b.value FROM c a JOIN c b ON a.user_id = b.user_id AND a.side = 'in' AND b.side = 'out' AND b.n BETWEEN a.n + 1 AND a.n + 4)
SELECT user_id, ask_seq, reply_seq, value AS reply FROM p QUALIFY row_number() OVER (PARTITION BY user_id, ask_seq ORDER BY value DESC, reply_seq) = 1""")
def best_reply(t: Tables) -> DataFrame:
    """The reply of the best score among the next four (rows J8, N15)."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    found = threads.next_replies(sided(t).withColumn("seq", F.row_number().over(w).cast("long")), "user_id", "seq", "side", "value", "in", "out", 4)
    return found.groupBy("user_id", "ask_seq").agg(F.max_by(F.struct("reply_seq", "reply"), F.struct("reply", -F.col("reply_seq"))).alias("x")).select("user_id", "ask_seq", "x.*")


@query(f"""WITH {SIDED}, f AS (SELECT user_id, min(ts) FILTER (WHERE side = 'in') AS first_ask FROM sided GROUP BY 1)
SELECT s.user_id, first_ask, min(ts) FILTER (WHERE side = 'out' AND ts >= first_ask) AS first_reply FROM sided s JOIN f ON s.user_id IS NOT DISTINCT FROM f.user_id GROUP BY ALL""")
def funnel_first_match(t: Tables) -> DataFrame:
    """The first reply at or after a thread's first question (row J10)."""
    out = threads.first_reply_after(sided(t), "user_id", "ts", "side", "in", "out")
    return out.select("user_id", F.col("first_ask").cast("timestamp_ntz").alias("first_ask"), F.col("first_reply").cast("timestamp_ntz").alias("first_reply"))


@query("""WITH f AS (SELECT user_id, min(ts) AS a, min(ts) FILTER (WHERE event_type = 'purchase') AS p, min(ts) FILTER (WHERE event_type = 'signup') AS s FROM events GROUP BY 1)
SELECT user_id, round((epoch_us(p) - epoch_us(a)) / 86400e6, 6) AS days_to_purchase, round((epoch_us(s) - epoch_us(a)) / 86400e6, 6) AS days_to_signup FROM f""")
def days_to_first(t: Tables) -> DataFrame:
    """Days from a thread's start to its first hits (rows W5, W6)."""
    days = lambda kind: threads.days_to_first(t.events, "user_id", "ts", ["ts", "event_id"], F.col("event_type") == kind).select("user_id", F.round("days", 6).alias(f"days_to_{kind}"))
    return t.events.select("user_id").distinct().join(days("purchase"), "user_id", "left").join(days("signup"), "user_id", "left")


@query("""WITH s AS (SELECT user_id, count(*) AS n, CASE WHEN count(ts) >= 2 THEN (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 END AS span FROM events GROUP BY 1)
SELECT count(*) AS threads, round(coalesce(median(span), 0), 3) AS median_span_s, round(coalesce(median(n), 0), 3) AS median_messages, sum(n)::BIGINT AS messages FROM s""")
def median_span(t: Tables) -> DataFrame:
    """Spans and sizes of threads (rows W4, A11)."""
    s = threads.spans(t.events, "user_id", "ts")
    return s.agg(F.count("*").alias("threads"), F.round(numbers.median_or_zero(F.col("span_s")), 3).alias("median_span_s"), F.round(numbers.median_or_zero(F.col("n").cast("double")), 3).alias("median_messages"), F.sum("n").alias("messages"))


@query("""SELECT event_type, count(*) AS n, min(value) AS least, round(avg(value), 6) AS mean, list_sort(list(value))[greatest(1, floor(0.95 * count(*))::INT)] AS p95, max(value) AS most FROM events GROUP BY 1""")
def p95_floor_rank(t: Tables) -> DataFrame:
    """Summaries of a metric by group with the floor-rank p95 (rows A26, A28)."""
    ranks = ranking.order_statistics(t.events, ["event_type"], "value", {"p95": numbers.floor_rank()}).select(F.col("event_type").alias("__e"), "p95")
    plain = t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("most"))
    return plain.join(ranks, F.col("event_type").eqNullSafe(F.col("__e")), "left").drop("__e")


@query("""SELECT user_id, list_sort(list(value))[round_even(0.9 * (count(*) - 1), 0)::INT + 1] AS p90 FROM events GROUP BY 1""")
def nearest_rank_p90(t: Tables) -> DataFrame:
    """Nearest-rank percentile with round-half-even (row A10)."""
    return ranking.order_statistics(t.events, ["user_id"], "value", {"p90": numbers.nearest_rank(0.9)}).drop("n")


@query("""SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY (ts IS NULL), ts, event_id) = 1""")
def first_outgoing(t: Tables) -> DataFrame:
    """The earliest dated message of each client (row W7)."""
    return threads.first_dated(t.events, "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query(f"""WITH {MESSAGES}, s AS (SELECT thread, count(*) AS n, count(*) FILTER (WHERE role = 'client') AS c, count(*) FILTER (WHERE role = 'manager') AS m FROM messages GROUP BY 1)
SELECT thread, n FROM s WHERE c > 0 AND m > 0 ORDER BY n DESC, thread LIMIT 40""")
def topn_threads(t: Tables) -> DataFrame:
    """The longest two-way threads (rows O6, O7)."""
    s = messages(t).groupBy("thread").agg(F.count("*").alias("n"), F.count_if(F.col("role") == "client").alias("c"), F.count_if(F.col("role") == "manager").alias("m"))
    return ranking.top(s.where("c > 0 and m > 0").select("thread", "n"), 40, F.col("n").desc(), "thread")


@query(f"""WITH RECURSIVE {MESSAGES}, r AS (SELECT thread, seq, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY thread ORDER BY seq) AS k FROM messages),
p AS (SELECT thread, seq, k, n AS used, 1::BIGINT AS pack FROM r WHERE k = 1
  UNION ALL SELECT r.thread, r.seq, r.k, CASE WHEN p.used > 0 AND p.used + r.n > 1500 THEN r.n ELSE p.used + r.n END, CASE WHEN p.used > 0 AND p.used + r.n > 1500 THEN p.pack + 1 ELSE p.pack END
  FROM p JOIN r ON p.thread = r.thread AND r.k = p.k + 1)
SELECT thread, seq, pack FROM p""")
def budget_packing(t: Tables) -> DataFrame:
    """Messages of a thread packed in order under a budget of characters (rows W13, L5)."""
    return ranking.greedy_packs(messages(t).withColumn("size", F.length(text.text("text"))), "thread", "seq", "size", 1500)

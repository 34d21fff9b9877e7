"""Counts, totals, mentions, quality comparisons and host metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, tokens
from ..operators import ranking
from .registry import MESSAGES, Tables, messages, query

CHANNELS = {"phone": r"\+[0-9]|555-", "mail": r"@[a-z0-9]+\.", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "license": r"licensed under", "tables": r"\|", "code": r"[0-9a-f]{18,}"}
TOPICS = {"money": ("token", "card", "pay"), "night": ("night", "noch", "nuit"), "articles": ("the ", "der ", "les ", "los "), "thing": ("thing", "ding", "cosa"), "and": ("and", "und", "avec", "para")}


@query("""SELECT o_custkey AS client, count(*) AS messages, count(*) FILTER (WHERE o_orderstatus = 'O') AS outgoing, count(*) FILTER (WHERE o_orderstatus = 'F') AS incoming,
  strftime(min(o_orderdate), '%Y-%m-%d') AS first_date, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date,
  CASE WHEN count(*) FILTER (WHERE o_orderstatus = 'O') > 0 AND count(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 'yes' ELSE 'no' END AS two_way FROM orders GROUP BY 1""")
def client_index(t: Tables) -> DataFrame:
    """A row a client: messages by direction, first and last day, two-way flag (rows A1, A3)."""
    out, inc = F.count_if(F.col("o_orderstatus") == "O"), F.count_if(F.col("o_orderstatus") == "F")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.orders.groupBy(F.col("o_custkey").alias("client")).agg(F.count("*").alias("messages"), out.alias("outgoing"), inc.alias("incoming"), day(F.min("o_orderdate")).alias("first_date"), day(F.max("o_orderdate")).alias("last_date"), F.when((out > 0) & (inc > 0), "yes").otherwise("no").alias("two_way"))


@query("""SELECT coalesce(o_orderstatus, 'all') AS status, coalesce(o_orderpriority, 'all') AS priority, count(*) AS n, count(DISTINCT o_custkey) AS clients, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)""")
def totals_rollup(t: Tables) -> DataFrame:
    """Totals at each level in one pass (rows A2, A3, A18)."""
    made = t.orders.rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("clients"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return made.select(F.coalesce("o_orderstatus", F.lit("all")).alias("status"), F.coalesce("o_orderpriority", F.lit("all")).alias("priority"), "n", "clients", "total")


@query(f"""WITH {MESSAGES}, s AS (SELECT thread, count(*) AS n, bool_or(role = 'client') AND bool_or(role = 'manager') AS both_ways FROM messages GROUP BY 1)
SELECT count(*) AS threads, count(*) FILTER (WHERE both_ways) AS two_way, sum(n)::BIGINT AS messages FROM s""")
def two_way_threads(t: Tables) -> DataFrame:
    """Threads, two-way threads and messages (rows A2, A3)."""
    s = messages(t).groupBy("thread").agg(F.count("*").alias("n"), (F.bool_or(F.col("role") == "client") & F.bool_or(F.col("role") == "manager")).alias("both_ways"))
    return s.agg(F.count("*").alias("threads"), F.count_if("both_ways").alias("two_way"), F.sum("n").alias("messages"))


@query("SELECT channel, n FROM (SELECT " + ", ".join(f"count(*) FILTER (WHERE regexp_matches(lower(text), '{p}')) AS {k}" for k, p in CHANNELS.items()) + f" FROM documents) UNPIVOT (n FOR channel IN ({', '.join(CHANNELS)}))")
def mention_counts(t: Tables) -> DataFrame:
    """Texts that match each pattern, in one pass, as rows (rows A5, A6, P22)."""
    low = F.lower(text.text("text"))
    row = t.documents.agg(*[F.count_if(low.rlike(p)).alias(k) for k, p in CHANNELS.items()])
    return row.unpivot([], list(CHANNELS), "channel", "n")


@query("""SELECT upper(zone) AS zone, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '(?:^|[^a-z])(the|der|les|los|una)(?:[^a-z]|$)', 1)) AS zone FROM documents) GROUP BY 1""")
def distinct_mentions(t: Tables) -> DataFrame:
    """Mentions counted once a text (row A4)."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(text.text("text")), F.lit(r"(?:^|[^a-z])(the|der|les|los|una)(?:[^a-z]|$)"), F.lit(1)))
    return t.documents.select("doc_id", F.explode(found).alias("zone")).distinct().groupBy(F.upper("zone").alias("zone")).agg(F.count("*").alias("n"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS topic, count(*) AS n FROM documents WHERE {' OR '.join(f'contains(lower(text), {chr(39)}{w}{chr(39)})' for w in ws)}" for k, ws in TOPICS.items()))
def topic_counts(t: Tables) -> DataFrame:
    """Texts with any keyword of a topic, as substrings (row A7)."""
    low = F.lower(text.text("text"))
    any_of = lambda ws: F.array_max(F.array(*[F.contains(low, F.lit(w)) for w in ws]))
    return t.documents.agg(*[F.count_if(any_of(ws)).alias(k) for k, ws in TOPICS.items()]).unpivot([], list(TOPICS), "topic", "n")


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL")
def excluded_by_type(t: Tables) -> DataFrame:
    """Counts by source and kind (rows A18, A19, A16)."""
    return t.documents.groupBy("source", "lang").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_suppkey AS id, count(DISTINCT l_orderkey) AS chats FROM lineitem GROUP BY 1) SELECT id, chats, s_name AS name FROM c JOIN supplier ON id = s_suppkey ORDER BY chats DESC, id LIMIT 1""")
def company_identity(t: Tables) -> DataFrame:
    """The id that occurs in most distinct chats (row A17)."""
    c = t.lineitem.groupBy(F.col("l_suppkey").alias("id")).agg(F.countDistinct("l_orderkey").alias("chats"))
    best = c.agg(F.max_by(F.struct("id", "chats"), F.struct("chats", -F.col("id"))).alias("x")).select("x.*")
    return best.join(t.supplier, F.col("id") == F.col("s_suppkey")).select("id", "chats", F.col("s_name").alias("name"))


@query("""WITH s AS (SELECT doc_id * 1000000 + k AS seq, trim(x) AS sentence FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '\\s+', ' ', 'g'), '. ')) AS x, generate_subscripts(string_split(regexp_replace(text, '\\s+', ' ', 'g'), '. '), 1) AS k FROM documents) WHERE length(trim(x)) BETWEEN 25 AND 220)
SELECT sentence, count(*) AS n, min(seq) AS first_seen FROM s GROUP BY 1 ORDER BY n DESC, first_seen, sentence LIMIT 30""")
def phrase_frequency(t: Tables) -> DataFrame:
    """The most frequent sentences of a length, ties to the first seen (rows A8, O4, O5)."""
    parts = t.documents.select("doc_id", F.posexplode(F.split(F.regexp_replace(text.text("text"), r"[ \t\n\r\f]+", " "), r"\. ")).alias("k", "x"))
    s = parts.select((F.col("doc_id") * 1_000_000 + F.col("k") + 1).alias("seq"), F.trim("x").alias("sentence")).where(F.length("sentence").between(25, 220))
    return ranking.most_common(s, "sentence", 30, "seq").select("sentence", "n", "first_seen")


@query("""WITH w AS (SELECT doc_id, text, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z]{4,}'), lambda x: x NOT IN ('that', 'this', 'with', 'from')))) AS words FROM documents),
k AS (SELECT array_to_string(words[1:6], ' ') AS bucket, doc_id, text FROM w)
SELECT bucket, count(*) AS n, min(doc_id) AS first_doc, md5(arg_min(text, doc_id)) AS example_md5 FROM k GROUP BY 1 HAVING count(*) > 1""")
def question_buckets(t: Tables) -> DataFrame:
    """Texts by their first key words, with the first seen as example (row A9)."""
    words = F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text.text("text")), F.lit("[a-z]{4,}"), F.lit(0)), lambda x: ~x.isin("that", "this", "with", "from"))))
    k = t.documents.select("doc_id", "text", F.array_join(F.slice(words, 1, 6), " ").alias("bucket"))
    made = k.groupBy("bucket").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.min_by("text", "doc_id").alias("e"))
    return made.where("n > 1").select("bucket", "n", "first_doc", F.md5(F.col("e").cast("binary")).alias("example_md5"))


@query("""SELECT source, count(*) AS documents, (sum(length(text)) // 4)::BIGINT AS tokens, round(sum(length(text)) / 4e6 * 0.06, 6) AS cost FROM documents GROUP BY 1""")
def token_estimate(t: Tables) -> DataFrame:
    """Estimated tokens and cost by source (rows A20, A21, A22)."""
    chars = F.sum(tokens.estimated_tokens(F.col("text")))
    return t.documents.groupBy("source").agg(F.count("*").alias("documents"), F.expr("sum(length(coalesce(text, ''))) div 4").alias("tokens"), F.round(chars / 4e6 * 0.06, 6).alias("cost"))


@query("""WITH c AS (SELECT md5(text) AS k, count(*) AS frequency, count(DISTINCT source) AS sources FROM documents GROUP BY 1) SELECT frequency, count(*) AS clusters, sum(sources)::BIGINT AS sources FROM c GROUP BY 1""")
def frequency_histogram(t: Tables) -> DataFrame:
    """How many clusters have which frequency (rows A24, A25)."""
    c = t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("k")).agg(F.count("*").alias("frequency"), F.countDistinct("source").alias("sources"))
    return c.groupBy("frequency").agg(F.count("*").alias("clusters"), F.sum("sources").alias("sources"))


@query("""SELECT metric, count(v) AS n, min(v) AS least, round(avg(v), 6) AS mean, list_sort(list(v))[greatest(1, floor(0.95 * count(v))::INT)] AS p95, max(v) AS most
FROM (SELECT l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem) UNPIVOT (v FOR metric IN (quantity, discount, tax)) GROUP BY 1""")
def host_metric_summary(t: Tables) -> DataFrame:
    """Wide metrics to long rows, then n, min, mean, p95, max (rows A26, A27, A28)."""
    from ..functions.numbers import floor_rank
    from ..operators.ranking import order_statistics

    wide = t.lineitem.select(F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    long = wide.unpivot([], ["quantity", "discount", "tax"], "metric", "v")
    ranks = order_statistics(long, ["metric"], "v", {"p95": floor_rank()}).drop("n")
    plain = long.groupBy("metric").agg(F.count("v").alias("n"), F.min("v").alias("least"), F.round(F.avg("v"), 6).alias("mean"), F.max("v").alias("most"))
    return plain.join(ranks, "metric", "left").select("metric", "n", "least", "mean", "p95", "most")


@query("""PIVOT (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) ON l_linestatus IN ('F', 'O') USING sum(l_quantity) GROUP BY l_returnflag""")
def status_pivot(t: Tables) -> DataFrame:
    """Counters of a group as columns (row A28)."""
    return t.lineitem.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity"))


@query("""SELECT source, sum(strlen(text))::BIGINT AS before, sum(strlen(replace(text, ' ', '')))::BIGINT AS after, count(*) FILTER (WHERE strlen(text) - strlen(replace(text, ' ', '')) > 50) AS quoted, round(100.0 * (1 - sum(strlen(replace(text, ' ', ''))) / sum(strlen(text))), 4) AS reduction_pct
FROM documents GROUP BY 1 ORDER BY before - after DESC, source LIMIT 20""")
def cleaning_totals(t: Tables) -> DataFrame:
    """Bytes before and after cleaning by thread, the largest reductions first (rows A14, A15, O9)."""
    before, after = F.octet_length("text"), F.octet_length(F.replace(F.col("text"), F.lit(" "), F.lit("")))
    s = t.documents.groupBy("source").agg(F.sum(before).alias("before"), F.sum(after).alias("after"), F.count_if(before - after > 50).alias("quoted"))
    s = s.withColumn("reduction_pct", F.round(100.0 * (1 - F.col("after") / F.col("before")), 4))
    return ranking.top(s, 20, (F.col("before") - F.col("after")).desc(), "source")


@query()
def ab_histogram(t: Tables) -> DataFrame:
    """Similarity of two answers a question in four classes, with lengths (rows A23, N17, O10)."""
    pairs = t.benchmark.select("item_id", F.col("text").alias("answer"), F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.reverse("text")).alias("exp_answer"))
    r = ranking.ratios(pairs, "answer", "exp_answer")
    kind = F.when(F.col("ratio") >= 0.9, "same").when(F.col("ratio") >= 0.7, "near").when(F.col("ratio") >= 0.4, "partly").otherwise("other")
    return r.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.round(F.median(F.length("answer")), 1).alias("median_chars"))


@query("""SELECT user_id % 7 AS telegram_id, count(*) AS rated, round(avg(1 + (event_id * 7919) % 10), 6) AS mean_rate, min(1 + (event_id * 7919) % 10) AS worst FROM events WHERE event_type = 'click' GROUP BY 1""")
def usage_rating_stats(t: Tables) -> DataFrame:
    """Ratings by user from a usage log (rows T11, K19)."""
    log = t.events.where("event_type = 'click'").select((F.col("user_id") % 7).alias("telegram_id"), (1 + (F.col("event_id") * 7919) % 10).alias("rate"))
    return log.groupBy("telegram_id").agg(F.count("*").alias("rated"), F.round(F.avg("rate"), 6).alias("mean_rate"), F.min("rate").alias("worst"))


@query("""SELECT event_type, CAST(props->>'k' AS BIGINT) // 10 AS bucket, count(*) AS n FROM events GROUP BY ALL""")
def json_buckets(t: Tables) -> DataFrame:
    """A JSON field parsed and counted (rows S24, N21)."""
    return t.events.groupBy("event_type", F.expr("cast(get_json_object(props, '$.k') as bigint) div 10").alias("bucket")).agg(F.count("*").alias("n"))

"""End-to-end plans: conversation analytics, question mining, retrieval and sync."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, tokens
from ..functions.numbers import uuid5
from ..operators import clusters, joins, ranking, threads
from ..providers import Embedder, FirstSentence, HashingEmbedder, Model, completed, embedded


#: Items whose sizes meet in one task of map_reduce.
RUN = 10_000


def knowledge_base(messages: DataFrame, channels: dict[str, str], topics: dict[str, tuple[str, ...]]) -> dict[str, DataFrame]:
    """Totals, channel and topic counts, and the client index of messages (thread, seq, role, text)."""
    low = F.lower(text.text("text"))
    any_of = lambda ws: F.array_max(F.array(*[F.contains(low, F.lit(w)) for w in ws]))
    both = F.bool_or(F.col("role") == threads.CLIENT) & F.bool_or(F.col("role") == threads.MANAGER)
    index = messages.groupBy("thread").agg(F.count("*").alias("messages"), F.count_if(F.col("role") == threads.CLIENT).alias("incoming"), F.count_if(F.col("role") == threads.MANAGER).alias("outgoing"), both.alias("two_way"))
    return {
        "totals": index.agg(F.count("*").alias("clients"), F.count_if("two_way").alias("two_way"), F.sum("messages").alias("messages")),
        "index": index,
        "channels": messages.agg(*[F.count_if(low.rlike(p)).alias(k) for k, p in channels.items()]).unpivot([], list(channels), "channel", "n"),
        "topics": messages.agg(*[F.count_if(any_of(ws)).alias(k) for k, ws in topics.items()]).unpivot([], list(topics), "topic", "n"),
    }


def map_reduce(items: DataFrame, ident: str, body: str, model: Model | None = None, budget: int = 12_000, least: int = 1, depth: int = 4) -> DataFrame:
    """(pack, reply): each item is summarised, then packs of summaries under a budget, until a pack is left. Packs are runs of
    items in order; a run of RUN items is packed by one task, and no pack goes beyond it."""
    model = model or FirstSentence()
    notes = completed(items, body, model).select(F.lit(0).alias("g"), F.col(ident).cast("long").alias("k"), F.coalesce("reply", F.lit("")).alias("reply"))
    for _ in range(depth):
        notes = clusters.stored(ranking.dense_numbers(notes.drop("g"), "g", "k").withColumn("g", F.floor((F.col("g") - 1) / RUN).cast("int")))
        packs = ranking.greedy_packs(notes.withColumn("size", F.length("reply")), "g", "k", "size", budget)
        joined = notes.join(packs, ["g", "k"]).groupBy("g", "pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "reply"))), lambda x: x["reply"]), "\n").alias("prompt"))
        notes = completed(joined, "prompt", model).select("g", (F.col("g") * F.lit(RUN) + F.col("pack")).cast("long").alias("k"), F.coalesce("reply", F.lit("")).alias("reply"))
        if packs.select("g", "pack").distinct().limit(least + 1).count() <= least:
            break
    return notes.select(F.col("k").alias("pack"), "reply")


def question_pairs(messages: DataFrame, most: int = 4) -> DataFrame:
    """(pair_id, thread, question, answer, question_score, answer_score) of questions with the best of the next replies."""
    replies = threads.next_replies(messages, "thread", "seq", "role", "text", threads.CLIENT, threads.MANAGER, most)
    asked = messages.where(F.col("role") == threads.CLIENT).select("thread", F.col("seq").alias("ask_seq"), F.posexplode(tokens.questions(text.incoming_text(F.col("text")))).alias("k", "question"))
    scored = asked.join(replies, ["thread", "ask_seq"]).withColumn("answer", tokens.best_paragraph(F.col("reply"), F.col("question"))).where("answer <> ''")
    scored = scored.withColumn("answer_score", tokens.combined_score(F.col("answer"), F.col("question"), raw=F.col("reply")))
    best = scored.groupBy("thread", "ask_seq", "k", "question").agg(F.max_by("answer", F.struct("answer_score", -F.col("nth"))).alias("answer"), F.max("answer_score").alias("answer_score"))
    return best.select(F.xxhash64("thread", "ask_seq", "k").alias("pair_id"), "thread", "question", "answer", tokens.representative_score(F.col("question")).alias("question_score"), "answer_score")


def faq(pairs: DataFrame, threshold: float = 0.38, themes: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """A row a cluster of similar questions, with its best answer and variants; cluster_id numbers the clusters from the most frequent.

    Pairs link by the pair rule, large clusters of little cohesion are split, and what is left is merged by the rule of clusters
    over representatives; root is the smallest pair_id of the result."""
    theme_of = lambda c: tokens.theme(F.col(c), themes) if themes else F.lit("other")

    def linked(found: DataFrame, items: DataFrame, ident: str, question: str, rule) -> DataFrame:
        side = lambda n: items.select(F.col(ident).alias(n), F.col("theme").alias(f"t{n}"), tokens.distinctive_words(F.col(question)).alias(f"d{n}"))
        both = found.join(side("a"), "a").join(side("b"), "b")
        similarity = F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))
        return both.where(rule(similarity, clusters.one_theme(F.col("ta"), F.col("tb")), F.size(F.array_intersect("da", "db"))))

    p = clusters.stored(pairs.withColumns({"signature": tokens.signature(F.col("question")), "theme": theme_of("question"), "language": text.rule_language(F.col("question"))}))
    edges = linked(clusters.token_pairs(p, "pair_id", "signature"), p, "pair_id", "question", lambda s, t, d: clusters.pair_rule(F.col("shared"), s, t, d, threshold))
    members = clusters.stored(p.join(clusters.components(p, edges, "pair_id"), "pair_id"))

    size = members.groupBy("root").agg(F.count("*").alias("n"))
    large = members.join(size.where("n > 8"), "root", "left_semi")
    shaped = members.join(size, "root").join(clusters.cohesion(large, "root", "pair_id", "signature"), "root", "left")
    # a cluster has one theme, so only the words part it
    part = clusters.split_key(F.col("root"), F.col("n"), F.coalesce("cohesion", F.lit(1.0)), F.lit(""), tokens.distinctive_words(F.col("question")))
    members = clusters.stored(clusters.split_clusters(shaped.withColumn("__part", part), "root", "__part", "part").drop("__part", "n", "cohesion"))

    whole = members.where(F.col("part") == F.col("root").cast("string")).where("theme <> 'other'")
    named = clusters.majority(whole, ["part"], "theme", "pair_id", "main")
    heads = clusters.summaries(members.drop("root").withColumnRenamed("part", "root")).select(F.col("root").alias("part"), "representative")
    heads = clusters.stored(heads.join(named, "part", "left").select("part", "representative", F.coalesce("main", theme_of("representative")).alias("theme"), tokens.clustering_words(F.col("representative")).alias("w")))
    edges = linked(clusters.token_pairs(heads, "part", "w"), heads, "part", "representative", lambda s, t, d: clusters.cluster_rule(s, t, d, threshold))
    merged = clusters.stored(members.drop("root").join(clusters.components(heads, edges, "part"), "part"))

    first = merged.groupBy("root").agg(F.min("pair_id").alias("__first"))
    rows = clusters.summaries(merged.join(first, "root").drop("root").withColumnRenamed("__first", "root"))
    return ranking.dense_numbers(rows, "cluster_id", F.desc("frequency"), F.desc("best_score"), "representative", "root")


def index_points(chunks: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Chunks with point ids and vectors."""
    prepared = chunks.withColumns({"point_id": uuid5(F.col("id")), "embedding_text": tokens.embedding_text(F.col("subject"), F.col("text"))})
    return embedded(prepared, "embedding_text", embedder or HashingEmbedder()).drop("embedding_text")


def retrieve(points: DataFrame, questions: DataFrame, k: int = 6, slots: int = 2, least: float = 0.3, official: str = "official", embedder: Embedder | None = None, where=None) -> DataFrame:
    """(query_id, rank, id, score, reserved) for questions (query_id, question): top k with reserved slots for official chunks."""
    queries = embedded(questions, "question", embedder or HashingEmbedder(), out="query_vector")
    found = ranking.search(points, queries, k, where=where, ident="id")
    extra = ranking.search(points, queries, slots, where=(F.col("source") == official) if where is None else where & (F.col("source") == official), ident="id")
    named = found.unionByName(extra).join(points.select("id", "source"), "id")
    return ranking.reserved_slots(named, ["query_id"], F.col("source") == official, "id", k, slots, least).select("query_id", "rank", "id", "score", "reserved")


def answers(points: DataFrame, questions: DataFrame, model: Model | None = None, embedder: Embedder | None = None, k: int = 6, expand: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(query_id, context, answer): questions expanded if asked for, retrieved, put into a prompt, completed and cleaned."""
    asked = expand(questions) if expand else questions
    found = retrieve(points, asked, k, embedder=embedder).join(points.select("id", "text", "source"), "id")
    block = F.format_string("[%d] (%s) %s", "rank", "source", "text")
    context = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("x")))), lambda s: s["x"]), "\n\n").alias("context"))
    prompts = questions.join(context, "query_id", "left").withColumn("prompt", F.concat_ws("\n\n", F.coalesce("context", F.lit("")), "question"))
    return completed(prompts, "prompt", model or FirstSentence()).select("query_id", "context", text.sanitize_markdown(F.col("reply")).alias("answer"))


def sync(points: DataFrame, snapshot: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """Points after a snapshot (chunk_id, content_sha256, text): only added and changed rows are embedded, removed and orphaned ones go."""
    diff = joins.snapshot_diff(points, snapshot, "chunk_id", "content_sha256")
    changed = embedded(snapshot.join(joins.to_upsert(diff).select("chunk_id"), "chunk_id", "left_semi"), "text", embedder or HashingEmbedder())
    return joins.upsert(joins.delete_keys(points, diff.where("op = 'removed'"), "chunk_id"), changed, "chunk_id")

"""Similarity, components, clusters and question mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tokens
from ..operators import clusters
from .registry import Tables, query

# word sets of whole texts, without stop words; equal sets are a class, known by its smallest id
_STOP = ", ".join(f"'{w}'" for w in tokens.STOP)
_ITEMS = f"""items AS (SELECT doc_id, source, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']{{3,}}'), lambda x: x NOT IN ({_STOP})))) AS w FROM documents),
classes AS (SELECT doc_id, len(w) AS n, w, min(doc_id) OVER (PARTITION BY w) AS rep FROM items WHERE len(w) > 0),
post AS (SELECT doc_id, n, unnest(w) AS t FROM classes WHERE doc_id = rep),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM post a JOIN post b ON a.t = b.t AND a.doc_id < b.doc_id AND a.n >= 0.6 * b.n AND b.n >= 0.6 * a.n GROUP BY 1, 2),
pairs AS (SELECT a, b, c / (na + nb - c) AS similarity FROM shared WHERE c / (na + nb - c) >= 0.6 UNION ALL SELECT rep, doc_id, 1.0 FROM classes WHERE doc_id <> rep)"""


def items(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "source", "text", tokens.content_words(F.col("text")).alias("w"))


@query(f"WITH {_ITEMS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def jaccard_pairs(t: Tables) -> DataFrame:
    """Similar texts by an inverted index on their rarest words: pairs of classes of equal word sets, and their members (row J12)."""
    return clusters.similarity_edges(items(t), "doc_id", "w", 0.6).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_ITEMS}, e AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM items UNION SELECT r.a, e.y FROM reach r JOIN e ON r.b = e.x)
SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY 1""")
def cluster_components(t: Tables) -> DataFrame:
    """Connected components of the similar texts (rows C4, C5)."""
    sets = clusters.token_sets(items(t), "doc_id", "w")
    return clusters.components(sets, clusters.set_edges(sets, "doc_id", 0.6), "doc_id")


@query(f"""WITH RECURSIVE {_ITEMS}, e AS (SELECT a AS x, b AS y FROM pairs UNION ALL SELECT b, a FROM pairs),
reach AS (SELECT doc_id AS a, doc_id AS b FROM items UNION SELECT r.a, e.y FROM reach r JOIN e ON r.b = e.x),
labelled AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY 1),
words AS (SELECT doc_id, len(w) AS n, unnest(w) AS t FROM items),
inner_pairs AS (SELECT l.root, p.a, p.b, c / (na + nb - c) AS s FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb FROM words a JOIN words b ON a.t = b.t AND a.doc_id < b.doc_id JOIN labelled la ON a.doc_id = la.doc_id JOIN labelled lb ON b.doc_id = lb.doc_id AND la.root = lb.root GROUP BY 1, 2) p JOIN labelled l ON p.a = l.doc_id JOIN labelled m ON p.b = m.doc_id AND l.root = m.root)
SELECT k.root, k.n AS frequency, round(CASE WHEN k.n < 2 THEN 1.0 ELSE coalesce(s.s, 0) / (k.n * (k.n - 1) / 2) END, 6) AS cohesion, m.source AS main_source
FROM (SELECT root, count(*) AS n FROM labelled GROUP BY 1) k LEFT JOIN (SELECT root, sum(s) AS s FROM inner_pairs GROUP BY 1) s USING (root)
JOIN (SELECT root, source FROM (SELECT root, source, count(*) AS n, min(doc_id) AS f FROM labelled JOIN items USING (doc_id) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY root ORDER BY n DESC, f) = 1) m USING (root) WHERE k.n > 1""")
def cluster_summary(t: Tables) -> DataFrame:
    """Size, cohesion and majority source of each cluster (rows A29, A31)."""
    sets = clusters.token_sets(items(t), "doc_id", "w", "source")
    roots = clusters.stored(clusters.components(sets, clusters.set_edges(sets, "doc_id", 0.6), "doc_id"))
    size = clusters.stored(roots.groupBy("root").agg(F.count("*").alias("frequency")).where("frequency > 1"))
    members = sets.join(clusters.few(clusters.stored(roots.join(size, "root", "left_semi"))), "doc_id")
    main = clusters.majority(members, ["root"], "source", "doc_id", "main_source")
    return size.join(clusters.set_cohesion(members, "root", "doc_id"), "root").join(main, "root").select("root", "frequency", F.round("cohesion", 6).alias("cohesion"), "main_source")


@query("""WITH lines AS (SELECT doc_id, lower(unnest(string_split(text, chr(10)))) AS x FROM documents), b AS (SELECT item_id, lower(unnest(string_split(text, chr(10)))) AS x FROM benchmark)
SELECT doc_id, item_id, count(DISTINCT x) AS lines FROM lines JOIN b USING (x) WHERE length(x) >= 40 GROUP BY ALL""")
def known_lines(t: Tables) -> DataFrame:
    """Known lines found in texts by an equi-join (row P16: nested known text)."""
    line = lambda df, k: df.select(k, F.explode(F.split(F.lower("text"), "\n")).alias("x")).where(F.length("x") >= 40)
    return line(t.documents, "doc_id").join(line(t.benchmark, "item_id"), "x").groupBy("doc_id", "item_id").agg(F.countDistinct("x").alias("lines"))


_PAIRS = f"""a AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, lead(role) OVER w AS next_role, coalesce(lead(text) OVER w, '') AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id * 100 + turn AS pair_id, text AS question, reply AS answer, length(reply) AS score, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']{{3,}}'), lambda x: x NOT IN ({_STOP}))[1:3])), ' ') AS k FROM a WHERE role = 'user' AND next_role = 'assistant')"""


@query(f"""WITH {_PAIRS} SELECT k AS root, count(*) AS frequency, md5(arg_max(answer, struct_pack(s := score, f := -pair_id))) AS answer_md5, max(score)::BIGINT AS best_score FROM p GROUP BY 1""")
def faq_catalog(t: Tables) -> DataFrame:
    """Question and answer pairs grouped by signature, the best answer of each (rows N15, A29, A30, K13)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    a = t.conversations.select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("reply"))
    p = a.where("role = 'user' and next_role = 'assistant'").select((F.col("conv_id") * 100 + F.col("turn")).alias("pair_id"), F.coalesce("reply", F.lit("")).alias("answer"), F.array_join(tokens.signature(F.col("text"), 3), " ").alias("root"))
    return p.groupBy("root").agg(F.count("*").alias("frequency"), F.md5(F.max_by("answer", F.struct(F.length("answer"), -F.col("pair_id"))).cast("binary")).alias("answer_md5"), F.max(F.length("answer")).cast("long").alias("best_score"))


@query("""WITH s AS (SELECT md5(text) AS k, count(*) AS frequency, max(n_chars) AS best_score FROM documents GROUP BY 1)
SELECT CASE WHEN frequency >= 3 THEN 'frequent' WHEN best_score >= 2000 THEN 'rare' ELSE 'review' END AS route, count(*) AS n FROM s GROUP BY 1""")
def faq_routes(t: Tables) -> DataFrame:
    """Clusters routed to frequent, rare and review (rows P13-P15)."""
    s = t.documents.groupBy(F.md5(F.col("text").cast("binary")).alias("k")).agg(F.count("*").alias("frequency"), F.max("n_chars").alias("best_score"), F.max("text").alias("best_answer"))
    return clusters.routed(s, 3, 2000, 0, F.lit(True)).groupBy("route").agg(F.count("*").alias("n"))

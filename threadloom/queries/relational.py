"""Semi, anti and full joins, set operations, upserts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, ranking
from .registry import Tables, query


@query("SELECT d.doc_id, d.lang, d.n_chars FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def semi_allowlist(t: Tables) -> DataFrame:
    """Documents on an allow-list (rows J1, P2, S30)."""
    return joins.allow(t.documents, t.labels.where("quality = 1"), "doc_id").select("doc_id", "lang", "n_chars")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL)")
def anti_excluded(t: Tables) -> DataFrame:
    """Documents not on a deny-list (rows J2, U3)."""
    return joins.deny(t.documents, t.labels.where("toxic = 1"), "doc_id").select("doc_id", "source")


@query("""SELECT l.doc_id, quality FROM labels l JOIN documents d USING (doc_id) WHERE quality = 1 AND source NOT IN ('src1', 'src2')""")
def flagged_without_domains(t: Tables) -> DataFrame:
    """Flagged rows without those of excluded domains (rows S30, U3)."""
    rows = t.labels.join(t.documents.select("doc_id", "source"), "doc_id")
    excluded = t.documents.where(F.col("source").isin("src1", "src2")).select(F.col("source").alias("domain")).distinct()
    return joins.flagged_without(rows, F.col("quality") == 1, F.col("source"), excluded).select("doc_id", "quality")


# two snapshots of orders: the old lacks keys of one residue, the new of another, and some totals differ
_OLD = "SELECT o_orderkey AS chunk_id, CAST(o_totalprice * 100 AS BIGINT) AS fingerprint FROM orders WHERE o_orderkey % 7 <> 0"
_NEW = "SELECT o_orderkey AS chunk_id, CAST(o_totalprice * 100 AS BIGINT) + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS fingerprint FROM orders WHERE o_orderkey % 5 <> 0"


def snapshots(t: Tables) -> tuple[DataFrame, DataFrame]:
    base = t.orders.select(F.col("o_orderkey").alias("chunk_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("fingerprint"))
    changed = base.withColumn("fingerprint", F.col("fingerprint") + F.when(F.col("chunk_id") % 11 == 0, 1).otherwise(0))
    return base.where("chunk_id % 7 <> 0"), changed.where("chunk_id % 5 <> 0")


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW})
SELECT coalesce(o.chunk_id, n.chunk_id) AS chunk_id, CASE WHEN o.chunk_id IS NULL THEN 'added' WHEN n.chunk_id IS NULL THEN 'removed' ELSE 'changed' END AS op, o.fingerprint AS old_fingerprint, n.fingerprint AS new_fingerprint
FROM o FULL JOIN n ON o.chunk_id = n.chunk_id WHERE o.fingerprint IS DISTINCT FROM n.fingerprint""")
def manifest_diff(t: Tables) -> DataFrame:
    """Added, changed and removed entries of two snapshots (row J3)."""
    return joins.snapshot_diff(*snapshots(t), "chunk_id", "fingerprint")


@query(f"""WITH o AS ({_OLD}), n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM o WHERE false""")
def incremental_sync(t: Tables) -> DataFrame:
    """Old plus upserts minus removals equals the new snapshot (rows T1, K10, K11, U5)."""
    old, new = snapshots(t)
    diff = joins.snapshot_diff(old, new, "chunk_id", "fingerprint")
    rows = joins.to_upsert(diff).select("chunk_id", F.col("new_fingerprint").alias("fingerprint"))
    return joins.delete_keys(joins.upsert(old, rows, "chunk_id"), diff.where("op = 'removed'"), "chunk_id")


@query("SELECT DISTINCT l_orderkey AS chunk_id FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def reconcile_orphans(t: Tables) -> DataFrame:
    """Keys that exist without being expected (rows J4, U4)."""
    existing = t.lineitem.select(F.col("l_orderkey").alias("chunk_id"))
    return joins.orphans(existing, t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("chunk_id")), "chunk_id")


@query("""SELECT c_custkey, c_name FROM customer WHERE lower(trim(c_name)) NOT IN (SELECT lower(trim(c_name)) FROM customer WHERE c_custkey % 3 = 0 AND c_acctbal >= 0)""")
def resume_anti(t: Tables) -> DataFrame:
    """Rows still to do: not done, or done with a failure (rows J6, J7, S32, S35)."""
    done = t.customer.where("c_custkey % 3 = 0")
    return joins.pending(t.customer, done, "c_name", failed=F.col("c_acctbal") < 0).select("c_custkey", "c_name")


@query("""SELECT 'd' || doc_id AS id, 'documents' AS source, text IS NOT NULL AS has_text, lang FROM documents UNION ALL SELECT 'b' || item_id, 'benchmark', text IS NOT NULL, NULL FROM benchmark UNION ALL SELECT 'p' || page_id, 'pages', html IS NOT NULL, NULL FROM pages""")
def union_sources(t: Tables) -> DataFrame:
    """Chunks of three sources with unlike columns (rows U1, S19)."""
    part = lambda df, k, prefix, name, body: df.select(F.concat(F.lit(prefix), F.col(k)).alias("id"), F.lit(name).alias("source"), F.col(body).isNotNull().alias("has_text"), *(["lang"] if "lang" in df.columns else []))
    parts = [part(t.documents, "doc_id", "d", "documents", "text"), part(t.benchmark, "item_id", "b", "benchmark", "text"), part(t.pages, "page_id", "p", "pages", "html")]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("SELECT s_nationkey AS nationkey FROM supplier WHERE s_acctbal > 5000 UNION SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def union_distinct_ids(t: Tables) -> DataFrame:
    """A set union of ids (rows U2, S5, S6)."""
    return t.supplier.where("s_acctbal > 5000").select(F.col("s_nationkey").alias("nationkey")).union(t.customer.where("c_acctbal > 9000").select("c_nationkey")).distinct()


@query("""SELECT * FROM (SELECT p_partkey, p_name FROM part WHERE p_size < 30 UNION ALL SELECT p_partkey, p_name FROM part p WHERE p_size >= 25 AND p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 30))""")
def sync_missing(t: Tables) -> DataFrame:
    """A target completed with a source's missing points (rows J5, U10)."""
    cols = ["p_partkey", "p_name"]
    return joins.sync_missing(t.part.where("p_size < 30").select(cols), t.part.where("p_size >= 25").select(cols), "p_partkey")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size NOT BETWEEN 10 AND 20 UNION ALL SELECT p_partkey, 'merged' FROM part WHERE p_size = 10""")
def replace_entries(t: Tables) -> DataFrame:
    """Entries removed by key and merged ones added (row U9)."""
    cols = ["p_partkey", "p_brand"]
    return joins.replace_entries(t.part.select(cols), t.part.where("p_size between 10 and 20"), t.part.where("p_size = 10").select("p_partkey", F.lit("merged").alias("p_brand")), "p_partkey")


@query("""SELECT s_suppkey, coalesce(n_name, s_nationkey::VARCHAR) AS shown FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 2 = 0) ON s_nationkey = n_nationkey""")
def dimension_lookup(t: Tables) -> DataFrame:
    """A display name by lookup, else the key (rows J16, J15)."""
    names = t.nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.lookup(t.supplier, names, "s_nationkey", "n_name", "shown").select("s_suppkey", "shown")


@query("""SELECT p.p_partkey, CASE WHEN p.p_partkey % 4 = 0 AND p.p_size > 10 THEN upper(p.p_name) ELSE p.p_name END AS p_name FROM part p""")
def overlay_rows(t: Tables) -> DataFrame:
    """A model's rows laid over the originals, kept where missing (row J14)."""
    changes = t.part.where("p_partkey % 4 = 0").select("p_partkey", F.when(F.col("p_size") > 10, F.upper("p_name")).alias("p_name"))
    return joins.overlay(t.part.select("p_partkey", "p_name"), changes, "p_partkey", ["p_name"])


@query("""SELECT d.doc_id, row_number() OVER (ORDER BY l.doc_id DESC) AS place FROM (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) l JOIN documents d USING (doc_id)""")
def chunks_for_entries(t: Tables) -> DataFrame:
    """Chunks by a list of ids, with their place (rows J17, P26, S10)."""
    wanted = ranking.dense_numbers(t.labels.where("toxic = 1").select("doc_id").distinct().join(t.documents.select("doc_id"), "doc_id", "left_semi"), "place", F.col("doc_id").desc())
    return joins.in_given_order(t.documents.select("doc_id"), wanted, "doc_id", "place").select("doc_id", "place")


@query("""SELECT DISTINCT l_suppkey AS id FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F'""")
def distinct_nested_ids(t: Tables) -> DataFrame:
    """Distinct ids inside nested rows (rows J18, S29, P8)."""
    nested = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("id"))).alias("deals"))
    return joins.distinct_ids(t.orders.where("o_orderstatus = 'F'").join(nested, F.col("o_orderkey") == F.col("l_orderkey")), "deals", "id")


@query("""SELECT min(doc_id) AS doc_id, text_key FROM (SELECT doc_id, CASE WHEN length(text) >= 400 THEN 'id:' || md5(text) ELSE 'by:' || md5(concat_ws(chr(31), lang, source, substr(text, 1, 120))) END AS text_key FROM documents) GROUP BY text_key""")
def dedupe_first_wins(t: Tables) -> DataFrame:
    """The first row of each key, with a fallback key where there is no id (rows W9, T14)."""
    text = F.coalesce("text", F.lit(""))
    key = F.when(F.length(text) >= 400, F.concat(F.lit("id:"), F.md5(text.cast("binary")))).otherwise(F.concat(F.lit("by:"), F.md5(F.concat_ws("\x1f", "lang", "source", F.substring(text, 1, 120)).cast("binary"))))
    kept = joins.first_wins(t.documents.select("doc_id", key.alias("text_key")), F.col("text_key"), ["doc_id"])
    return kept.select("doc_id", "text_key")


@query("SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 10")
def offset_limit(t: Tables) -> DataFrame:
    """A page of a stable order (rows O13, S27)."""
    return ranking.page(t.documents.select("doc_id", "n_chars"), 10, 25, F.col("n_chars").desc(), "doc_id")


@query("SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS number FROM documents")
def dense_renumbering(t: Tables) -> DataFrame:
    """Numbers over a whole order without one task for all (rows W11, O11, O12, C6)."""
    return ranking.dense_numbers(t.documents.select("doc_id", "n_chars"), "number", F.col("n_chars").desc(), "doc_id").select("doc_id", "number")


@query()
def random_sample(t: Tables) -> DataFrame:
    """A seeded random row choice (rows O15, O16)."""
    return ranking.random_rows(t.customer.select("c_custkey", "c_name"), 25, 42, "c_custkey")

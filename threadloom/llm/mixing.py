"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source). A token budget goes down the tree by weights. At each parent it is filled like
water: children whose capacity (tokens times the most epochs) is under their share take their capacity, and what they
leave goes to their siblings by weight; only what a whole subtree cannot take rises to its ancestors' other children.
A leaf reads its documents in seeded epochs, each in an order of its own, up to its budget: whole epochs, then the
prefix of the next order whose tokens fit.

The prefix is found without sorting a leaf: tokens are summed by the leading digits of the order key, and only
documents of the one group where the budget ends are put in order. A leaf may so hold any share of the corpus.

Cases: null text has no tokens; null lang or source is the leaf value ''; leaves without tokens get none; documents of
no tokens go with their place in the order; rows of one doc_id share their place, so are taken together; a null doc_id
counts as the id ''; an empty table gives no rows. Weights are positive integers; what rounding leaves is unused.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEAF = ("domain", "lang", "source")
PREFIX = 3  # hex digits, 4096 groups a leaf
BROADCAST_LEAVES = 20_000


@dataclass(frozen=True)
class Plan:
    """Weights by name, with a default; domains maps sources to theirs; the budget is num / den of all tokens."""

    domains: dict = field(default_factory=dict)
    domain: dict = field(default_factory=dict)
    lang: dict = field(default_factory=dict)
    source: dict = field(default_factory=dict)
    other_domain: str = "general"
    weight: int = 1
    num: int = 3
    den: int = 5
    epochs: int = 2
    seed: int = 17


def case_sql(column: str, values: dict, default) -> str:
    """A CASE over a column that Spark and DuckDB both read."""
    text = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"CASE {' '.join(f'WHEN {column} = {text(k)} THEN {text(v)}' for k, v in values.items())} ELSE {text(default)} END" if values else text(default)


def tree_sql(plan: Plan, big: str, over: str) -> str:
    """Leaf budgets from a table leaves(domain, lang, source, tokens); big is a type for exact products, over its floor division."""
    levels = []
    for depth, name in enumerate(LEAF):
        keys, parents = ", ".join(LEAF[: depth + 1]), ", ".join(LEAF[:depth])
        by = f"PARTITION BY {parents} " if depth else ""
        weight = case_sql(name, getattr(plan, name), plan.weight)
        before = f"SELECT {parents}, budget AS b FROM given{depth - 1}" if depth else f"SELECT (sum(tokens) * {plan.num}) {over} {plan.den} AS b FROM leaves"
        join = f"JOIN before{depth} USING ({parents})" if depth else f"CROSS JOIN before{depth}"
        levels.append(f"""before{depth} AS ({before}),
node{depth} AS (SELECT {keys}, CAST(sum(tokens) * {plan.epochs} AS {big}) AS cap, CAST({weight} AS {big}) AS w FROM leaves GROUP BY {keys}),
placed{depth} AS (SELECT {keys}, cap, w, CAST(b AS {big}) AS b,
  sum(cap) OVER ({by}ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE), {name} ROWS UNBOUNDED PRECEDING) - cap AS taken,
  sum(w) OVER ({by}ORDER BY CAST(cap AS DOUBLE) / CAST(w AS DOUBLE) DESC, {name} DESC ROWS UNBOUNDED PRECEDING) AS open_w
  FROM node{depth} {join}),
full{depth} AS (SELECT *, CAST(cap AS {big}) * CAST(open_w AS {big}) <= w * CAST(b - taken AS {big}) AS whole FROM placed{depth}),
rest{depth} AS (SELECT {parents + ', ' if depth else ''}sum(CASE WHEN whole THEN cap ELSE 0 END) AS gone, sum(CASE WHEN whole THEN 0 ELSE w END) AS rest_w FROM full{depth}{f' GROUP BY {parents}' if depth else ''}),
given{depth} AS (SELECT {keys}, CASE WHEN whole THEN CAST(cap AS BIGINT) ELSE CAST((w * CAST(b - gone AS {big})) {over} CAST(rest_w AS {big}) AS BIGINT) END AS budget
  FROM full{depth} {f'JOIN rest{depth} USING ({parents})' if depth else f'CROSS JOIN rest{depth}'})""")
    return "WITH " + ",\n".join(levels) + f"\nSELECT {', '.join(LEAF)}, tokens, budget FROM leaves JOIN given{len(LEAF) - 1} USING ({', '.join(LEAF)})"


def order_key(plan: Plan, epoch: Column, id_col: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{plan.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"))


def tokens_of(text: Column) -> Column:
    """A token for every four bytes begun."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def with_leaf(docs: DataFrame, plan: Plan) -> DataFrame:
    """docs with a struct column __leaf of its leaf and tokens."""
    source = F.coalesce(F.col("source"), F.lit(""))
    domain = F.lit(plan.other_domain)
    if plan.domains:
        domain = F.coalesce(F.create_map(*[F.lit(x) for kv in plan.domains.items() for x in kv])[source], domain)
    return docs.withColumn("__leaf", F.struct(domain.alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), source.alias("source"), tokens_of(F.col("text")).alias("tokens")))


def leaf_cuts(docs: DataFrame, plan: Plan) -> DataFrame:
    """(domain, lang, source, tokens, budget, whole_epochs, cut): an order key up to cut is in the epoch after the whole ones."""
    slim = with_leaf(docs.select("doc_id", "text", "lang", "source"), plan).select("doc_id", "__leaf.*")
    leaves = slim.groupBy(*LEAF).agg(F.sum("tokens").alias("tokens"))
    leaves = written(leaves, "leaves")
    sql = tree_sql(plan, "DECIMAL(38,0)", "DIV").replace("FROM leaves", "FROM {leaves}")
    budgets = docs.sparkSession.sql(sql, leaves=leaves)
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0)
    budgets = written(budgets.withColumn("whole_epochs", whole).withColumn("left", F.col("budget") - F.col("whole_epochs") * F.col("tokens")), "budgets")
    keyed = slim.withColumnRenamed("tokens", "t").join(few(budgets), list(LEAF)).withColumn("key", order_key(plan, F.col("whole_epochs"), F.col("doc_id"))).withColumn("group", F.substring("key", 1, PREFIX))
    groups = keyed.groupBy(*LEAF, "left", "group").agg(F.sum("t").alias("t"))
    ran = groups.withColumn("upto", F.expr(f"sum(t) over (partition by {', '.join(LEAF)} order by group rows unbounded preceding)"))
    edge = ran.where("upto > left").groupBy(*LEAF).agg(F.min_by(F.struct("group", (F.col("upto") - F.col("t")).alias("before")), "group").alias("e")).select(*LEAF, "e.*")
    edge = written(edge, "edges")
    inside = keyed.join(few(edge), [*LEAF, "group"]).groupBy(*LEAF, "group", "before", "left", "key").agg(F.sum("t").alias("t"))
    inside = inside.withColumn("upto", F.expr(f"before + sum(t) over (partition by {', '.join(LEAF)} order by key rows unbounded preceding)"))
    last = inside.where("upto <= left").groupBy(*LEAF).agg(F.max("key").alias("last"))
    cuts = budgets.join(edge.select(*LEAF, "group"), list(LEAF), "left").join(last, list(LEAF), "left")
    return written(cuts.select(*LEAF, "tokens", "budget", "whole_epochs", F.when(F.col("left") <= 0, "").otherwise(F.coalesce("last", "group", F.lit("g"))).alias("cut")), "cuts")


def few(leaves: DataFrame) -> DataFrame:
    """A broadcast hint where the leaves are at most BROADCAST_LEAVES; a plain join otherwise."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def with_copies(docs: DataFrame, plan: Plan) -> DataFrame:
    """The rows of docs with __leaf (domain, lang, source, tokens, budget) and __copies, how often the mixture has the row."""
    cuts = leaf_cuts(docs, plan)
    named = cuts.select(*[F.col(c).alias(f"__{c}") for c in LEAF], "budget", "whole_epochs", "cut")
    rows = with_leaf(docs, plan).withColumns({f"__{c}": F.col(f"__leaf.{c}") for c in LEAF})
    named = named.select(*[f"__{c}" for c in LEAF], F.struct("budget", "whole_epochs", "cut").alias("__plan"))
    joined = rows.join(few(named), [f"__{c}" for c in LEAF])
    copies = F.when(F.col("__plan.budget") <= 0, 0).otherwise(F.col("__plan.whole_epochs") + (order_key(plan, F.col("__plan.whole_epochs"), F.col("doc_id")) <= F.col("__plan.cut")).cast("long"))
    leaf = F.struct(*[F.col(f"__leaf.{c}").alias(c) for c in (*LEAF, "tokens")], F.col("__plan.budget").alias("budget"))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], leaf.alias("__leaf"), copies.alias("__copies"))


def mixture(docs: DataFrame, plan: Plan) -> DataFrame:
    """The mixed corpus: the columns of docs, whatever their names, each row as often as the mixture has it."""
    packed = docs.select("doc_id", "text", "lang", "source", F.struct("*").alias("__row"))
    taken = with_copies(packed, plan).where("__copies > 0")
    return taken.select("__row", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))).alias("__k")).select("__row.*")

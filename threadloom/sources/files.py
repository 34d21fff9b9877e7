"""File sources: messages, threads, chunks, catalogs, chat and CRM exports, official files and metrics.

Live services (mailboxes, CRM, drives) are read from what an exporter has landed: .eml files, JSON lines, JSON pages.
Filters and column lists given to the returned frames reach the reader as far as its format allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import numbers, text, tokens

LABELS = {"client": "Client:", "count": "Messages:", "subject": "Subject:", "from": "From:", "to": "To:", "date": "Date:"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark's own file system finds the path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: str, optional: bool = False) -> DataFrame:
    """JSON lines of a schema; malformed lines are dropped; a missing optional file is empty."""
    if optional and not exists(spark, path):
        return empty(spark, schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def messages(spark: SparkSession, cleaned: str | None, raw: str) -> DataFrame:
    """Cleaned thread files where there are any, else the raw JSON lines."""
    if cleaned and exists(spark, cleaned):
        return thread_messages(spark, cleaned)
    return json_lines(spark, raw, schemas.MESSAGE)


def chunks(spark: SparkSession, path: str, optional: bool = False) -> DataFrame:
    """The chunk corpus with its defaults."""
    df = json_lines(spark, path, schemas.CHUNK, optional)
    words = F.coalesce("word_count", text.word_count(F.col("text")))
    none = F.expr("cast(array() as array<string>)")
    return df.withColumns({"source": F.coalesce("source", F.lit("mailbox_thread")), "subject": F.coalesce("subject", F.lit("")), "manager_emails": F.coalesce("manager_emails", none), "low_signal": F.coalesce("low_signal", F.lit(False)), "word_count": words})


def faq(spark: SparkSession, path: str) -> DataFrame:
    """A catalog of questions as chunks: rows without a question or an answer go, the first language counts."""
    if not exists(spark, path):
        return empty(spark, schemas.CHUNK)
    rows = spark.read.schema(schemas.FAQ).csv(path, sep=";", header=True, multiLine=True, escape='"', enforceSchema=True)
    q, a = F.trim(text.text("question")), F.trim(text.text("answer"))
    kept = rows.where((q != "") & (a != ""))
    ident = F.concat(F.lit("faq__"), F.lpad(F.trim("number"), 4, "0"))
    return kept.select(
        ident.alias("id"),
        ident.alias("thread_id"),
        F.lit("faq").alias("source"),
        F.concat(F.lit("Q: "), q, F.lit("\nA: "), a).alias("text"),
        q.alias("subject"),
        F.lit(None).cast("string").alias("client_email"),
        F.expr("cast(array() as array<string>)").alias("manager_emails"),
        F.lit(None).cast("string").alias("date_start"),
        F.lit(None).cast("string").alias("date_end"),
        F.trim(F.get(F.split("languages", ","), 0)).alias("language"),
        F.lit(False).alias("low_signal"),
        text.word_count(F.concat_ws(" ", q, a)).alias("word_count"),
        F.lit(None).cast("string").alias("distilled"),
        F.create_map(F.lit("theme"), text.text("theme"), F.lit("frequency"), F.coalesce(F.col("frequency").try_cast("int"), F.lit(0)).cast("string")).alias("extra"),
    )


def all_chunks(spark: SparkSession, corpus: str, faq_csv: str | None = None, official: str | None = None) -> DataFrame:
    """The union of the corpus, the catalog and the official files' corpus; the last two may be missing."""
    out = chunks(spark, corpus)
    if faq_csv:
        out = out.unionByName(faq(spark, faq_csv), allowMissingColumns=True)
    if official:
        out = out.unionByName(chunks(spark, official, optional=True), allowMissingColumns=True)
    return out


def whole_files(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """(path, content) of text files below a folder, without a byte-order mark."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select("path", F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "").alias("content"))


def official_files(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """A manifest of files (chunk_id, file_path, content_sha256), or with size and time instead of a hash, which reads no content."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option("recursiveFileLookup", "true").load(root)
    bare = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    prefix = "/" + root.split(":", 1)[-1].strip("/") + "/" if ":" in root else root.rstrip("/") + "/"
    rel = F.regexp_replace(bare, "^" + prefix.replace(".", r"\."), "")
    mark = F.sha2("content", 256) if content else F.concat_ws(":", "length", F.unix_micros("modificationTime"))
    body = [F.regexp_replace(F.col("content").cast("string"), "^\ufeff", "").alias("text")] if content else []
    return raw.select(text.chunk_id(rel, "official").alias("chunk_id"), rel.alias("file_path"), mark.alias("content_sha256"), *body)


def thread_blocks(content: Column, rule: str = r"(?m)^={20,}[ \t]*$") -> Column:
    """The blocks of a thread text: struct<index, head, body>, index from 1 counting empty blocks, those without a dash rule left out."""
    parts = F.split(content, rule)
    block = lambda p, i: F.struct(i.alias("index"), F.trim(F.regexp_replace(p, r"^\s*\n", "")).alias("raw"))
    return F.filter(F.transform(F.slice(parts, 2, F.size(parts)), lambda p, i: block(p, i + 1)), lambda b: b["raw"].rlike(r"(?m)^-{20,}[ \t]*$"))


def header(head: Column, label: str) -> Column:
    """A labelled header with its folded continuation lines, on one line."""
    found = F.regexp_extract(head, rf"(?m)^{label}[ \t]*(.*(?:\n[ \t]+\S.*)*)", 1)
    return F.trim(F.regexp_replace(found, r"\s*\n\s+", " "))


def thread_messages(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """A row a message of thread text files: thread, client, declared count, index, role, headers, ts and body.

    A block is a role line, labelled headers in any order, a rule of dashes, and the body; a block without the rule is skipped
    and counted by thread_warnings."""
    names = LABELS | (labels or {})
    files = whole_files(spark, path)
    named = files.select(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.txt$", "").alias("thread"), "content")
    rows = named.select("thread", F.trim(F.regexp_extract("content", rf"(?m)^{names['client']}[ \t]*(.*)$", 1)).alias("client"), F.regexp_extract("content", rf"(?m)^{names['count']}[ \t]*(\d+)", 1).try_cast("int").alias("declared"), F.explode(thread_blocks(F.col("content"))).alias("b"))
    head, body = F.regexp_extract("b.raw", r"(?s)^(.*?)\n?-{20,}[ \t]*(?:\n|\z)", 1), F.regexp_replace(F.col("b.raw"), r"(?s)^.*?-{20,}[ \t]*(\n|\z)", "")
    role = F.upper(F.regexp_extract(head, r"\[\s*([^\s\]]+)", 1))
    parsed = rows.select("thread", "client", "declared", F.col("b.index").alias("index"), F.when(role.startswith("MANAGER"), "manager").when(role.startswith("CLIENT"), "client").otherwise("unknown").alias("role"), *[header(head, names[k]).alias(k) for k in ("subject", "from", "to", "date")], text.stripped(body).alias("text"))
    return parsed.withColumns({"ts": numbers.mail_date(F.col("date")), "word_count": text.word_count(F.col("text"))})


def thread_warnings(spark: SparkSession, path: str, labels: dict[str, str] | None = None) -> DataFrame:
    """(thread, declared, parsed) of threads whose parsed messages are not as many as declared."""
    m = thread_messages(spark, path, labels)
    return m.groupBy("thread").agg(F.max("declared").alias("declared"), F.count("*").alias("parsed")).where("declared is null or declared <> parsed")


def chat_messages(spark: SparkSession, path: str, company_id: str, kinds: tuple[str, ...] = ("personal_chat", "private_group")) -> DataFrame:
    """A row a message with content of a chat export: chat, name, index, role, author, ts, reply_to and body; stickers and contact cards go."""
    raw = spark.read.schema(schemas.CHAT_EXPORT).json(path, multiLine=True, primitivesAsString=True)
    chats = raw.select(F.explode("chats.list").alias("c")).where(F.col("c.type").isin(*kinds))
    m = chats.select(F.col("c.id").alias("chat"), F.col("c.name").alias("name"), F.posexplode("c.messages").alias("place", "m")).where("m.type = 'message'")
    body = text.message_body(text.rich_text(F.col("m.text")), text.media_placeholder(F.col("m.media_type"), F.col("m.photo"), F.col("m.file_name"), F.col("m.contact_information")))
    kept = m.withColumn("body", body).where("body is not null")
    from pyspark.sql.window import Window

    index = F.row_number().over(Window.partitionBy("chat").orderBy("place"))
    role = F.when(F.col("m.from_id") == company_id, "manager").otherwise("client")
    return kept.select("chat", "name", index.alias("index"), role.alias("role"), F.col("m.from").alias("author"), F.timestamp_seconds(F.col("m.date_unixtime").try_cast("long")).alias("ts"), F.col("m.reply_to_message_id").alias("reply_to"), "body")


def chat_company(spark: SparkSession, path: str) -> DataFrame:
    """(from_id, chats, name) of the author seen in most distinct chats, by the name used most."""
    raw = spark.read.schema(schemas.CHAT_EXPORT).json(path, multiLine=True)
    m = raw.select(F.explode("chats.list").alias("c")).select(F.col("c.id").alias("chat"), F.explode("c.messages").alias("m"))
    s = m.where("m.from_id is not null").groupBy(F.col("m.from_id").alias("from_id")).agg(F.countDistinct("chat").alias("chats"), F.mode("m.from").alias("name"))
    return s.orderBy(F.col("chats").desc(), "from_id").limit(1)


def crm_deals(spark: SparkSession, path: str) -> DataFrame:
    """A row a deal of landed CRM searches; null lists give none."""
    c = spark.read.schema(schemas.DEALS).json(path, multiLine=True).select(F.explode("results.deal_search.body.clients").alias("c"))
    return c.select(F.col("c.id").alias("client_id"), F.col("c.name").alias("client"), F.explode("c.deals_for_event").alias("d")).select("client_id", "client", "d.*")


def crm_clients(spark: SparkSession, path: str, email_type: int = 2, phone_type: int = 1) -> DataFrame:
    """A row a client with its first valid address, the others, and a phone."""
    c = spark.read.schema(schemas.CLIENTS).json(path, multiLine=True).select(F.explode("result").alias("c")).select("c.*")
    of = lambda kind: F.transform(F.filter(F.coalesce("contacts", F.expr("cast(array() as array<struct<type_id:int,value:string>>)")), lambda x: x["type_id"] == kind), lambda x: x["value"])
    emails = tokens.valid_emails(of(email_type))
    return c.select(F.col("id").alias("client_id"), "name", F.get(emails, 0).alias("email"), F.array_join(F.slice(emails, 2, 100), ", ").alias("additional_emails"), F.get(of(phone_type), 0).alias("phone"), "created_at", "updated_at")


def checked_csv(spark: SparkSession, path: str, required: tuple[str, ...], sep: str = ",") -> DataFrame:
    """A CSV with a header; an error names the required columns it lacks."""
    df = spark.read.csv(path, sep=sep, header=True, multiLine=True, escape='"')
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks {', '.join(missing)}")
    return df


def recent_csv(spark: SparkSession, path: str, schema: str, since: str) -> DataFrame:
    """CSV files changed since a time."""
    return spark.read.schema(schema).option("modifiedAfter", since).csv(path, header=True)


def allowed_users(spark: SparkSession, path: str) -> DataFrame:
    """(user_id) from a JSON list, or an object with allowed_user_ids; an empty list is an error."""
    raw = spark.read.text(path, wholetext=True).select(F.coalesce(F.get_json_object("value", "$.allowed_user_ids"), F.col("value")).alias("v"))
    ids = raw.select(F.explode(F.from_json("v", "array<bigint>")).alias("user_id")).where("user_id is not null").distinct()
    if ids.isEmpty():
        raise ValueError(f"{path} allows nobody")
    return ids

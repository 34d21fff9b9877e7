"""Mail files: MIME parsing needs Python's parser, so whole batches of .eml bytes go through Arrow."""

from __future__ import annotations

import codecs
import email
import email.header
import email.utils
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens
from ..functions.text import html_to_text


def decoded_header(value: str | None) -> str:
    """RFC 2047 words decoded; unknown charsets are read as UTF-8 with replacement."""
    out = []
    for part, charset in email.header.decode_header(value or ""):
        if isinstance(part, bytes):
            try:
                out.append(part.decode(charset or "utf-8", "replace"))
            except LookupError:
                out.append(part.decode("utf-8", "replace"))
        else:
            out.append(part)
    return "".join(out)


def bodies_of(message: email.message.Message) -> dict[str, str]:
    """The text/plain and the text/html parts of a message, each joined; attachments are left out and bytes that can't be read are skipped."""
    found: dict[str, list[str]] = {"text/plain": [], "text/html": []}
    for part in message.walk():
        kind = part.get_content_type()
        if kind in found and not part.is_multipart() and part.get_content_disposition() != "attachment":
            charset = part.get_content_charset() or "utf-8"
            try:
                codecs.lookup(charset)
            except LookupError:
                charset = "utf-8"
            found[kind].append((part.get_payload(decode=True) or b"").decode(charset, "ignore"))
    return {kind: "\n".join(parts).strip() for kind, parts in found.items()}


def eml_messages(spark: SparkSession, path: str, own_domains: tuple[str, ...], plain_only: bool = False) -> DataFrame:
    """Landed .eml files as messages; direction and counterpart come from the addresses, rows without either or a text go."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                m = email.message_from_bytes(bytes(raw))
                rows.append((name, *(decoded_header(m.get(h)) for h in ("Subject", "From", "To", "Cc", "Date", "Message-ID")), *bodies_of(m).values()))
            yield pd.DataFrame(rows, columns=["path", "subject", "from", "to", "cc", "date", "message_id", "plain", "rich"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", "true").load(path).select("path", "content")
    parsed = raw.mapInPandas(parse, "path string, subject string, `from` string, `to` string, cc string, date string, message_id string, plain string, rich string")
    body = F.col("plain") if plain_only else F.when(F.col("plain") != "", F.col("plain")).otherwise(html_to_text(F.col("rich"), rich=True))
    parsed = parsed.withColumn("text", body).drop("plain", "rich")
    own = lambda a: F.lit(False) if not own_domains else F.array_contains(F.array(*[F.lit(d) for d in own_domains]), F.substring_index(a, "@", -1))
    sender, others = tokens.addresses(F.col("from")), tokens.addresses(F.col("to"), F.col("cc"))
    automated = lambda a: a.rlike(r"^(no-?reply|mailer-daemon|postmaster|notifications?|bounce)[^@]*@")
    outside = lambda c: F.filter(c, lambda a: ~own(a) & ~automated(a))
    direction = F.when(F.exists(sender, own), "outgoing").otherwise("incoming")
    pool = F.when(direction == "outgoing", outside(others)).otherwise(outside(sender))
    counterpart = F.coalesce(F.get(pool, 0), F.get(outside(F.array_distinct(F.concat(sender, others))), 0))
    return parsed.withColumns({"direction": direction, "counterpart": counterpart}).where("counterpart is not null and trim(text) <> ''")

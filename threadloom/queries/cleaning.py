"""Text functions over the tables' texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text, tokens
from .registry import Tables, query

RULES = (("numbers", "[0-9]+"), ("articles", "(the|der|les|los) "), ("joins", "(and|und|et|y) "), ("tables", "[|]"))
SPACES = "[ \\t\\n\\r\\f\\v]"


def digest(c):
    return F.md5(c.cast("binary"))


@query(r"""SELECT page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p\s*>', chr(10) || chr(10), 'g'), '(?s)<[^>]+>', '', 'g'),
'&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text_md5 FROM pages""")
def html_to_text(t: Tables) -> DataFrame:
    """Markup to text (rows F3, F4)."""
    return t.pages.select("page_id", digest(text.html_to_text(F.col("html"))).alias("text_md5"))


@query(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[ \t\x{00A0}]+', ' ', 'g'), '\n +', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13))) AS text_md5, len(list_filter(string_split_regex(text, '[ \t\n\r\f\v]+'), lambda x: x <> '')) AS words FROM documents""")
def squeeze_whitespace(t: Tables) -> DataFrame:
    """White space normalised, words counted (rows F13, F19, N18)."""
    return t.documents.select("doc_id", digest(text.squeeze(F.col("text"))).alias("text_md5"), text.word_count(F.col("text")).cast("long").alias("words"))


@query(r"""SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'file__' || trim(regexp_replace(lower(regexp_replace(url, '[.][A-Za-z0-9]{1,5}$', '')), '[^a-z0-9]+', '-', 'g'), '-') AS chunk_id, trim(regexp_replace(lower(url), '[^a-z0-9._@-]+', '_', 'g'), '_') AS safe FROM pages""")
def slug_ids(t: Tables) -> DataFrame:
    """Slugs, chunk ids and safe names of paths (rows F27, F28, F31)."""
    return t.pages.select("page_id", text.slug(F.col("url")).alias("slug"), text.chunk_id(F.col("url")).alias("chunk_id"), text.safe_name(F.col("url")).alias("safe"))


@query(r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(list_last(string_split(path, '/')), '[.][^.]*$', ''), '^\d{8}[ _-]*', ''), '_+', ' ', 'g')) AS shown FROM (SELECT p_partkey, 'disk/' || p_brand || '/2024' || lpad((p_partkey % 12 + 1)::VARCHAR, 2, '0') || '01_' || replace(p_name, ' ', '_') || '.txt' AS path FROM part)""")
def display_subject(t: Tables) -> DataFrame:
    """A file's subject from its path (rows F29, F30)."""
    path = F.concat(F.lit("disk/"), "p_brand", F.lit("/2024"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0"), F.lit("01_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(".txt"))
    return t.part.select("p_partkey", text.display_subject(path).alias("shown"))


@query("""SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, 300) || chr(10) || '[...]' || chr(10) || right(text, 200) END AS cut, CASE WHEN length(text) > 100 THEN left(text, 91) || '... [cut]' ELSE text END AS cell FROM documents""")
def truncate_head_tail(t: Tables) -> DataFrame:
    """Head and tail around a marker; cells with a marker (rows W12, O17, F43, F44, K20)."""
    return t.documents.select("doc_id", text.head_and_tail(F.col("text"), 500).alias("cut"), text.truncated(F.col("text"), 100).alias("cell"))


@query(r"""SELECT item_id, trim(regexp_replace(regexp_replace(regexp_replace('## Title' || chr(10) || '**' || text || '**' || chr(10) || 'Sources: a' || chr(10) || 'b', '(?s)\n+\s*(?i:sources|references)\s*:.*\z', ''), '\*\*(.+?)\*\*', '\1', 'g'), '(?m)^#{1,6}\s*', '', 'g')) AS clean FROM (SELECT item_id, replace(text, chr(10), ' ') AS text FROM benchmark)""")
def sanitize_markdown(t: Tables) -> DataFrame:
    """Markdown marks and the list of sources removed (row F24)."""
    made = F.concat(F.lit("## Title\n**"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("**\nSources: a\nb"))
    return t.benchmark.select("item_id", text.sanitize_markdown(made).alias("clean"))


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']{{3,}}'), lambda x: x NOT IN ({0})))) AS c FROM documents) SELECT doc_id, len(c) AS n, md5(array_to_string(c, ' ')) AS words_md5 FROM w""".format(", ".join(f"'{w}'" for w in tokens.STOP)))
def content_words(t: Tables) -> DataFrame:
    """Distinct words that are no stop words (row N3)."""
    c = tokens.content_words(F.col("text"))
    return t.documents.select("doc_id", F.size(c).cast("long").alias("n"), digest(F.array_join(c, " ")).alias("words_md5"))


@query("""WITH w AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z'']{{3,}}'), lambda x: x NOT IN ({0}))[1:10])) AS c FROM documents) SELECT doc_id, array_to_string(c, ' ') AS signature FROM w""".format(", ".join(f"'{w}'" for w in tokens.STOP)))
def signature_first10(t: Tables) -> DataFrame:
    """The first ten words that are no stop words, as a set (row N4)."""
    return t.documents.select("doc_id", F.array_join(tokens.signature(F.col("text")), " ").alias("signature"))


_HITS = ", ".join(f"len(regexp_extract_all(lower(text), '{p}')) AS h{i}" for i, (_, p) in enumerate(RULES))
_BEST = "CASE " + " ".join(f"WHEN h{i} > 0 AND h{i} >= greatest({', '.join(f'h{j}' for j in range(len(RULES)))}) THEN '{n}'" for i, (n, _) in enumerate(RULES)) + " ELSE 'other' END"


@query(f"""WITH h AS (SELECT doc_id, {_HITS} FROM documents) SELECT doc_id, {_BEST} AS theme FROM h""")
def theme_argmax(t: Tables) -> DataFrame:
    """The rule of most hits, the earlier of ties (rows N7, C7)."""
    return t.documents.select("doc_id", tokens.theme(F.col("text"), RULES).alias("theme"))


@query("""SELECT doc_id, CASE WHEN regexp_matches(lower(text), '[0-9]+') THEN 'numbers' WHEN regexp_matches(lower(text), '(the|der|les|los) ') THEN 'articles' WHEN regexp_matches(lower(text), '(and|und|et|y) ') THEN 'joins' WHEN regexp_matches(lower(text), '[|]') THEN 'tables' ELSE 'other' END AS bucket FROM documents""")
def intent_buckets(t: Tables) -> DataFrame:
    """The first rule that matches (row C7)."""
    return t.documents.select("doc_id", tokens.bucket(F.col("text"), RULES).alias("bucket"))


@query("""SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9._%+-]+@[a-z0-9-]+(?:\\.[a-z0-9-]+)*\\.[a-z]{2,}')) AS found FROM documents""".replace("list_distinct(", "array_to_string(list_sort(list_distinct(").replace(") AS found", "))  , ' ') AS found"))
def address_extraction(t: Tables) -> DataFrame:
    """Distinct addresses of a text (rows U11, U12, N26, N27)."""
    return t.documents.select("doc_id", F.array_join(F.array_sort(tokens.addresses(F.col("text"))), " ").alias("found"))


@query("""WITH h AS (SELECT doc_id, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode('doc' || doc_id)) AS s FROM documents)
SELECT doc_id, s[1:8] || '-' || s[9:12] || '-5' || s[14:16] || '-' || lpad(lower(to_hex((('0x' || s[17:18])::INT & 63) | 128)), 2, '0') || s[19:20] || '-' || s[21:32] AS point_id FROM h""")
def point_uuid5(t: Tables) -> DataFrame:
    """Stable point ids (row V15)."""
    return t.documents.select("doc_id", numbers.uuid5(F.concat(F.lit("doc"), F.col("doc_id").cast("string"))).alias("point_id"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS read_back FROM orders""")
def mail_dates(t: Tables) -> DataFrame:
    """RFC 2822 dates written and parsed (rows F1, S2: date handling)."""
    made = F.concat(F.lit("Mon, "), F.date_format("o_orderdate", "d MMM yyyy HH:mm:ss"), F.lit(" +0000 (UTC)"))
    return t.orders.select("o_orderkey", F.date_format(numbers.mail_date(made), "yyyy-MM-dd HH:mm:ss").alias("read_back"))

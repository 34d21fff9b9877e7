import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.functions import numbers, text, tokens
from threadloom.operators import ranking


def one(spark, column, **values):
    """The value of a column over one row of the given values."""
    kinds = {str: "string", int: "int", float: "double", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("v")).first()["v"]


T = F.col("t")


@pytest.mark.parametrize(
    ("column", "given", "want"),
    [
        (text.html_to_text(T), "<p>a &lt;b&gt;</p><script>x</script>b<br>c", "a <b>\n\nb\nc"),
        (text.html_to_text(T, rich=True), "<div>a  b</div><li>c</li>", "a b\nc"),
        (text.strip_quoted_reply(T), "Yes.\nOn Monday, Ann wrote:\n> old", "Yes."),
        (text.strip_quoted_reply(T), "Yes.\n> old", "Yes."),
        (text.strip_quote_lines(T), "a\n> b\nc", "a\nc"),
        (text.strip_quote_tail(T), "Body here\n\nAnn wrote:", "Body here"),
        (text.strip_quote_tail(T), "Ann wrote:", "Ann wrote:"),
        (text.squeeze(T), "a   b\n\n\n\n  c ", "a b\n\nc"),
        (text.flatten(T), " a\n b ", "a b"),
        (text.sanitize_markdown(T), "# H\n**b** and *i*\nSources:\n1", "H\nb and i"),
        (text.slug(T), "A b/C--d.", "a-b-c-d"),
        (text.chunk_id(T), "x/Y z.txt", "file__x-y-z"),
        (text.display_subject(T), "d/20240101_big_file.txt", "big file"),
        (text.safe_name(T), "Ann+B@x.com", "ann_b@x.com"),
        (text.truncated(T, 12, "..."), "abcdefghijklmnop", "abcdefghi..."),
        (text.head_and_tail(T, 10, "~"), "abcdefghijklmnop", "abcdef~mnop"),
        (text.template_literal(T), "a`b${c}\\", "a\\`b\\${c}\\\\"),
        (text.inserted_before(T, "B", "x", "x"), "aBc", "axBc"),
        (text.inserted_before(T, "B", "x", "x"), "xBc", "xBc"),
        (text.renumbered(T, 2), "## 1. A\nx\n## 2. B\n", "## 3. A\nx\n## 4. B\n"),
        (text.trim_reply_chain(T), "Hello\nBest regards\nAnn", "Hello"),
        (text.anonymized(T, ["Bob"]), "Dear Ann, thank you for your email. Bob says yes to Mr. Smith Jones.\nBest regards\nX", "says yes to ."),
        (text.rich_text(T), '["a",{"type":"bold","text":"b"}]', "ab"),
        (text.rich_text(T), "plain", "plain"),
        (text.rule_language(T), "wann kommt der Hund", "de"),
        (text.rule_language(T), "ein schöner Hund, merci", "de"),
        (text.rule_language(T), "merci bien", "fr"),
        (text.rule_language(T), "the dog", "en"),
        (text.rule_language(T), "привет большой мир", "ru"),
        (text.rule_language(T), "привет мир", "en"),
        (tokens.normalized_email(T), " A@B.co ", "a@b.co"),
        (tokens.normalized_email(T), "nobody", None),
        (tokens.first_score(T), "score: 85.", 85),
        (tokens.first_score(T), "101", None),
        (tokens.first_score(T), "none", None),
        (tokens.json_strings(T), 'Sure: ```json\n["A", "a", " b ", ""]```', ["A", "b"]),
        (tokens.json_strings(T), "no array", []),
        (tokens.signature(T, 2), "what the price of package", ["package", "price"]),
        (tokens.theme(T, (("x", "a"), ("y", "b"))), "ab", "x"),
        (tokens.theme(T, (("x", "a"),)), "zz", "other"),
        (tokens.bucket(T, (("x", "a"), ("y", "b"))), "cb", "y"),
        (tokens.addresses(T), "X <a@b.co>, A@B.CO; c@d.org", ["a@b.co", "c@d.org"]),
        (text.sentences(T), "One. Two! Three", ["One.", "Two!", "Three"]),
        (text.word_count(T), "  ", 0),
        (text.word_count(T), None, 0),
        (text.letter_body(T), "head\n" + "-" * 40 + "\nbody", "body"),
        (text.text_chunks(T, 5), "aa bb cc", ["aa bb", "cc"]),
    ],
)
def test_text_columns(spark, column, given, want):
    assert one(spark, column, t=given) == want


def test_quotes_are_cut_past_the_first_characters(spark):
    body = "x" * 30
    got = one(spark, text.strip_quotes(T), t=f"{body}\n-----Original Message-----\nold")
    assert (got["text"], got["removed"]) == (body, 31)
    assert one(spark, text.strip_quotes(T), t="short\n> a")["removed"] == 0


def test_signature_goes_up_to_the_address(spark):
    t = "Answer.\nBest regards\nAnn\nann@corp.test\nPS: more"
    assert one(spark, text.strip_signature(T, F.lit("manager")), t=t).replace("\n", " ").split() == "Answer. PS: more".split()
    assert one(spark, text.strip_signature(T, F.lit("client")), t=t) == t


def test_splits_and_sections(spark):
    got = one(spark, text.split_at(T, "ANSWER:"), t="q answer: a")
    assert (got["before"], got["after"]) == ("q", "a")
    assert one(spark, text.numbered_sections(T), t="intro\n## 1. A\nx\n## 2. B\ny") == {1: "## 1. A\nx", 2: "## 2. B\ny"}
    with pytest.raises(Exception, match="not under root"):
        one(spark, text.relative_path(T, "/a"), t="/b/c")


def test_media_placeholders(spark):
    def shown(m, p=None, f=None, c=None):
        return one(spark, text.media_placeholder(F.col("m"), F.col("p"), F.col("f"), F.col("c")), m=m, p=p, f=f, c=c)

    assert [shown("voice_message"), shown("sticker"), shown(None, p="x"), shown(None, f="a.pdf"), shown(None, c="x")] == ["[voice]", None, "[photo]", "[file: a.pdf]", None]


def test_questions_and_answers(spark):
    q = "How much does the standard relocation package cost this year?"
    a = "The standard relocation package costs 900 euros a year, which includes documents and translation."
    assert one(spark, tokens.looks_like_question(T), t=q) is True
    assert one(spark, tokens.looks_like_question(T), t="Ok?") is False
    assert one(spark, tokens.admissible(F.col("a"), F.col("q")), a=a, q=q) is True
    assert one(spark, tokens.admissible(F.col("a"), F.col("q")), a=q, q=q) is False
    assert one(spark, tokens.best_paragraph(F.col("a"), F.col("q")), a=f"Unsubscribe here please, this is long enough noise.\n\n{a}", q=q) == a


def test_percentiles_and_medians(spark):
    df = spark.createDataFrame([(float(x),) for x in range(1, 21)], "v double")
    picks = {"a": numbers.nearest_rank(0.9), "b": numbers.floor_rank()}
    assert tuple(ranking.order_statistics(df, [], "v", picks).first()) == (20, 18.0, 19.0)
    assert df.agg(numbers.median_or_zero(F.col("v")).alias("c")).first().c == 10.5
    assert ranking.order_statistics(df.where("v > 99"), [], "v", picks).count() == 0
    assert df.where("v > 99").agg(numbers.median_or_zero(F.col("v")).alias("c")).first().c == 0.0


def test_order_statistics_equal_sorted_lists(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randint(0, 9)), rng.random() * 100, 5.0])) for _ in range(2000)] + [("one", 7.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.n, r.p90, r.p95) for r in ranking.order_statistics(df, ["k"], "v", {"p90": numbers.nearest_rank(0.9), "p95": numbers.floor_rank()}, groups=7).collect()}
    want = {}
    for k in ("a", "b", None, "one"):
        values = sorted(v for key, v in rows if key == k and v is not None)
        n = len(values)
        want[k] = (n, values[round(0.9 * (n - 1))], values[max(0, int(0.95 * n) - 1)])
    assert got == want


@pytest.mark.parametrize(("given", "want"), [("Mon, 05 Jan 2026 10:00:00 +0300", "2026-01-05 07:00:00"), ("5 Jan 2026 10:00:00 +0000 (UTC)", "2026-01-05 10:00:00"), ("Mon, 5 Jan 2026 10:00:00", "2026-01-05 10:00:00"), ("soon", None)])
def test_mail_dates(spark, given, want):
    assert one(spark, F.date_format(numbers.mail_date(T), "yyyy-MM-dd HH:mm:ss"), t=given) == want


def test_ids_and_vectors(spark):
    assert one(spark, numbers.uuid5(T), t="chunk-1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk-1"))
    from threadloom.providers import HashingEmbedder, embedded

    for t in ("some words words again", "", None, "Été x x x"):
        want = [0.0] * 256
        for w in (t or "").lower().split():
            want[int(hashlib.md5(w.encode()).hexdigest(), 16) % 256] += 1
        size = sum(x * x for x in want) ** 0.5 or 1.0
        want = [x / size for x in want]
        assert one(spark, numbers.hashed_vector(tokens.words_of(T, r"(?U)\w+"), 256), t=t) == pytest.approx(want)
        df = spark.createDataFrame([(t,)], "t string")
        assert embedded(df, "t", HashingEmbedder(256)).first().embedding == pytest.approx(want, abs=1e-6)
    assert one(spark, numbers.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0


def test_nfc_and_json_search(spark):
    from threadloom.functions import arrow

    assert one(spark, arrow.nfc(T), t="é") == "é" and one(spark, arrow.nfc(T), t=None) is None
    doc = '{"a": {"Question": "short", "list": [{"question_text": "the longest one", "x": 1}]}, "nation": "N"}'
    assert one(spark, arrow.longest_under(T, ("question",)), t=doc) == "the longest one"
    assert one(spark, arrow.first_under(T, ("question",)), t=doc) == "short"
    assert one(spark, arrow.first_under(T, ("nation",)), t="not json") == "" and one(spark, arrow.first_under(T, ("z",)), t=None) == ""

"""Tokens, question rules and scores as Column builders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as fixed
from .rules import GENERIC, STOP, Rules, any_of
from .text import anonymized, bound, flatten, paragraphs, sentences, strip_question_echo, stripped, text

def _array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.expr("cast(array() as array<string>)")


def words_of(c: Column, pattern: str = r"[a-z']{3,}") -> Column:
    """Words in lower case, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(pattern), F.lit(0))


def content_words(c: Column, stop: Sequence[str] = STOP) -> Column:
    """Distinct words without stop words, sorted."""
    return F.array_sort(F.array_except(F.array_distinct(words_of(c)), _array(stop)))


def signature(c: Column, n: int = 10, stop: Sequence[str] = STOP) -> Column:
    """The first n words that are no stop words, as a sorted set."""
    kept = F.filter(words_of(c), lambda w: ~F.array_contains(_array(stop), w))
    return F.array_sort(F.array_distinct(F.slice(kept, 1, n)))


def content_word_count(c: Column, stop: Sequence[str] = STOP) -> Column:
    kept = F.filter(words_of(c), lambda w: ~F.array_contains(_array(stop), w))
    return F.size(kept) + F.regexp_count(F.lower(text(c)), F.lit("[а-яё]{3,}"))


def distinctive_words(c: Column, generic: Sequence[str] = GENERIC, stop: Sequence[str] = STOP) -> Column:
    return F.array_except(content_words(c, stop), _array(generic))


def clustering_words(c: Column) -> Column:
    """The words that questions are grouped by: the distinctive ones (widening them by all others adds none, as these are generic)."""
    return distinctive_words(c)


def vocabulary_hits(c: Column, vocabulary: Sequence[str]) -> Column:
    return F.size(F.array_intersect(content_words(c), _array(vocabulary)))


def jaccard(a: Column, b: Column) -> Column:
    """|A and B| / |A or B|; 0 where either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def theme(c: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The rule of most hits; the earlier rule wins ties; default without any."""
    t = F.lower(text(c))
    scored = F.array(*[F.struct(F.regexp_count(t, F.lit(p)).alias("n"), F.lit(-i).alias("o"), F.lit(name).alias("name")) for i, (name, p) in enumerate(rules)])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["name"]).otherwise(F.lit(default))


def bucket(c: Column, rules: Sequence[tuple[str, str]], default: str = "other") -> Column:
    """The first rule that matches."""
    return F.coalesce(*[F.when(F.lower(text(c)).rlike(p), F.lit(name)) for name, p in rules], F.lit(default))


def topic_hits(c: Column, rules: Rules = Rules()) -> Column:
    """How many topic words a text has."""
    return F.size(F.array_intersect(F.array_distinct(words_of(c)), _array(rules.topics)))


def _found(c: Column, patterns: Sequence[str], flags: str = "i") -> Column:
    return c.rlike(any_of(tuple(patterns), flags))


def question_quality(c: Column, rules: Rules = Rules()) -> Column:
    """Words and topic words, two for length, less for generic questions, templates and few words."""
    less = lambda condition, by: F.when(condition, F.lit(float(by))).otherwise(0.0)

    def score(x: Column) -> Column:
        t, n, topics = x["t"], x["n"], x["topics"]
        plain = n * 1.5 + topics * 3.0 - less(F.length(t) >= 60, -2) - less(_found(t, fixed.GENERIC_QUESTION), 20) - less(_found(t, fixed.TEMPLATE_QUESTION), 15)
        return plain - less(n < 5, 5) - less((topics == 0) & (n < 8), 8)

    counted = lambda t: F.struct(t.alias("t"), content_word_count(t, rules.stop).alias("n"), topic_hits(t, rules).alias("topics"))
    return bound(bound(stripped(text(c)), counted), score)


def representative_score(c: Column, rules: Rules = Rules()) -> Column:
    """Quality of a question that stands for others: long ones lose."""
    n = F.length(text(c))
    return question_quality(c, rules) - F.when(n > 160, (n - 160) / 15.0).otherwise(0.0) - F.when(n > 280, 15.0).otherwise(0.0)


def looks_like_question(c: Column, rules: Rules = Rules(), least_words: int = 5, least_score: float = 4.0) -> Column:
    """Length, ending, words and quality of a question worth keeping, and none of what rejects it."""

    def gate(t: Column) -> Column:
        bad = _found(t, (*fixed.REJECTED, *rules.own)) | _found(t, fixed.REJECTED_EXACT, "") | (_found(t, fixed.HEADER_FRAGMENT) & (F.length(t) > 120))
        for patterns in (fixed.MANAGER_ASKS, fixed.NOISE_QUESTION, fixed.GENERIC_QUESTION, fixed.TEMPLATE_QUESTION, fixed.MANAGER_QUESTION, fixed.SCHEDULING):
            bad = bad | _found(t, patterns)
        kept = F.length(t).between(20, 420) & F.endswith(t, F.lit("?")) & ~bad
        return kept & (content_word_count(t, rules.stop) >= least_words) & (question_quality(t, rules) >= least_score)

    return bound(stripped(text(c)), gate)


def questions(c: Column, rules: Rules = Rules()) -> Column:
    return F.filter(sentences(c), lambda s: looks_like_question(s, rules))


def relevance(question: Column, answer: Column, rules: Rules = Rules()) -> Column:
    """How much of a question's words an answer has, four a distinctive word, less for templates, noise and invitations to a call."""
    topics = lambda c: F.array_intersect(F.array_distinct(words_of(c)), _array(rules.topics))
    less = lambda condition, by: F.when(condition, F.lit(float(by))).otherwise(0.0)

    def counted(x: Column) -> Column:
        q, a = x["q"], content_words(x["t"], rules.stop)
        special = F.array_except(q, _array(rules.generic))
        return F.struct(F.size(q).alias("n"), F.size(F.array_intersect(q, a)).alias("both"), F.size(special).alias("special"), F.size(F.array_intersect(special, a)).alias("named"), x["t"].alias("t"), x["ask"].alias("ask"))

    def score(x: Column) -> Column:
        t = x["t"]
        plain = x["both"] / F.greatest(F.least(x["n"], F.lit(12)), F.lit(1)) * 10.0 + x["named"] * 4.0 - less((x["named"] == 0) & (x["special"] >= 2), 8)
        plain = plain + F.when(x["both"] == 0, F.size(F.array_intersect(topics(x["ask"]), topics(t))) * 4.0).otherwise(0.0)
        offered = _found(t, rules.package) & ~_found(x["ask"], fixed.PACKAGE_QUESTION)
        return F.when(x["n"] == 0, 0.0).otherwise(plain - less(offered, 10) - less(_noise(t, rules), 15) - less(_found(F.substring(t, 1, 220), fixed.CALL_ONLY), 6))

    given = bound(text(question), lambda ask: F.struct(content_words(ask, rules.stop).alias("q"), ask.alias("ask"), text(answer).alias("t")))
    return bound(bound(given, counted), score)


def _noise(t: Column, rules: Rules) -> Column:
    return _found(t, (*fixed.ANSWER_NOISE, *rules.own), "im")


def answer_score(answer: Column, question: Column | None = None, rules: Rules = Rules(), raw: Column | None = None) -> Column:
    """Length up to a cap, digits, lists, links and topics, less for invitations, phrases and noise; half the relevance where a question
    is given. raw is the text that the answer was taken from. Under 50 characters it is 0."""
    plus = lambda condition, by: F.when(condition, F.lit(float(by))).otherwise(0.0)

    def score(t: Column) -> Column:
        r = t if raw is None else text(raw)
        plain = F.least(F.length(t), F.lit(1800)) / 100.0 + plus(t.rlike("[0-9]"), 1.5) + plus(t.rlike(r"[-•*]\s"), 2) + plus(t.rlike("(?i)https?://"), 1)
        plain = plain + plus(topic_hits(t, rules) >= 2, 2) + plus(F.substring(r, 1, 120).rlike("(?im)" + fixed.GREETING) | F.substring(r, 1, 200).rlike(fixed.HONORIFIC), -1)
        plain = plain + plus(_found(F.substring(t, 1, 220), fixed.CALL_ONLY), -5) + plus(_found(F.substring(t, 1, 160), fixed.BOILERPLATE), -3) + plus(_noise(t, rules), -8)
        return F.when(F.length(t) < 50, 0.0).otherwise(plain if question is None else plain + 0.5 * relevance(question, t, rules))

    return bound(text(answer), score)


def combined_score(answer: Column, question: Column, rules: Rules = Rules(), raw: Column | None = None) -> Column:
    """The score that answers are compared by."""
    return answer_score(answer, question, rules, raw) + 1.2 * relevance(question, answer, rules)


def has_substance(answer: Column, question: Column, least: int = 50) -> Column:
    """Long enough without the question's echo, more than the question, and no question itself unless it answers one."""
    bare = lambda c: stripped(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))

    def enough(x: Column) -> Column:
        own, a, q = x["own"], x["a"], x["q"]
        echo = (a == q) | (F.contains(a, q) & (F.length(a) < F.length(q) + 35))
        back = F.endswith(own, F.lit("?")) & ~x["whole"].rlike("(?i)" + fixed.ASKED_AND_ANSWERED)
        return (F.length(own) >= least) & ~echo & ~back

    given = lambda whole: bound(strip_question_echo(whole, question), lambda own: F.struct(own.alias("own"), bare(own).alias("a"), bare(text(question)).alias("q"), whole.alias("whole")))
    return bound(bound(text(answer), given), enough)


def admissible(answer: Column, question: Column, rules: Rules = Rules()) -> Column:
    """No noise, sign-off, greeting or client's voice; substance, relevance of three, and distinctive words in common where the question has them."""

    def gate(t: Column) -> Column:
        bad = _noise(t, rules) | _found(t, fixed.SIGN_OFF) | F.substring(t, 1, 80).rlike("(?im)" + fixed.GREETING) | t.rlike(r"(?i)^Dear\s") | _found(t, fixed.CLIENT_VOICE)
        bad = bad | t.rlike(r"Best regards,\s+[A-Z][a-z]+\s+[A-Z][a-z]+$")
        special = distinctive_words(question, rules.generic, rules.stop)
        shared = bound(special, lambda d: F.size(F.array_intersect(d, content_words(t, rules.stop))) >= F.least(F.lit(2), F.size(d)))
        fits = (F.length(stripped(text(question))) == 0) | ((relevance(question, t, rules) >= 3) & shared)
        return (F.length(t) >= 50) & ~bad & has_substance(t, question) & fits

    return bound(text(answer), gate)


def paragraph_score(paragraph: Column, question: Column, rules: Rules = Rules()) -> Column:
    """The score that paragraphs of one answer are compared by."""
    shared = F.size(F.array_intersect(signature(question, 10, rules.stop), signature(paragraph, 10, rules.stop)))
    offered = _found(paragraph, rules.package) & ~_found(text(question), fixed.PACKAGE_QUESTION)
    score = F.least(F.length(paragraph), F.lit(1200)) / 100.0 + shared * 2.5 + F.when(paragraph.rlike("[0-9]"), 1.0).otherwise(0.0)
    return score - F.when(_found(F.substring(paragraph, 1, 120), fixed.BOILERPLATE), 3.0).otherwise(0.0) - F.when(offered, 8.0).otherwise(0.0)


def best_paragraph(answer: Column, question: Column, most: int = 1800, rules: Rules = Rules()) -> Column:
    """The paragraph of the highest score without names and greetings, the first of ties; the whole answer where no paragraph is
    left; '' where that is not admissible."""
    noise = (any_of((*fixed.ANSWER_NOISE, *rules.own), "im"),)
    clean = F.filter(F.transform(paragraphs(answer, noise=noise, openings=(any_of(fixed.BOILERPLATE), any_of(fixed.CALL_ONLY))), lambda p: anonymized(p, rules.names)), lambda p: F.length(p) >= 50)
    scored = F.transform(clean, lambda p, i: F.struct(paragraph_score(p, question, rules).alias("s"), (-i).alias("o"), p.alias("p")))
    kept = strip_question_echo(F.coalesce(F.array_max(scored)["p"], anonymized(answer, rules.names)), question)
    return bound(kept, lambda k: F.when(admissible(k, question, rules), F.substring(k, 1, most)).otherwise(F.lit("")))


def first_score(c: Column, low: int = 1, high: int = 100) -> Column:
    """The first integer of a model's reply if it lies in range; else null."""
    n = F.expr("try_cast(x as int)") if c is None else F.regexp_extract(text(c), r"(\d{1,9})", 1).try_cast("int")
    return F.when(n.between(low, high), n)


def json_strings(c: Column) -> Column:
    """The strings of a JSON array in a reply, wherever it stands; blanks and repeats in another case go, order stays."""
    fenced = F.regexp_replace(text(c), r"(?s)```(?:json)?|```", "")
    array = F.regexp_extract(fenced, r"(?s)(\[.*\])", 1)
    raw = F.coalesce(F.from_json(array, "array<string>"), F.expr("cast(array() as array<string>)"))
    clean = F.filter(F.transform(raw, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    empty = F.expr("cast(array() as array<string>)")
    return F.aggregate(clean, empty, lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))))


def json_rows(c: Column, schema: str) -> Column:
    """The objects of a JSON array in a reply, or an empty array."""
    fenced = F.regexp_replace(text(c), r"(?s)```(?:json)?|```", "")
    return F.coalesce(F.from_json(F.regexp_extract(fenced, r"(?s)(\[.*\])", 1), f"array<{schema}>"), F.expr(f"cast(array() as array<{schema}>)"))


def embedding_text(subject: Column, body: Column) -> Column:
    s = F.trim(text(subject))
    return F.when(s != "", F.concat(F.lit("Subject: "), s, F.lit("\n\n"), text(body))).otherwise(text(body))


def normalized_email(c: Column) -> Column:
    """Trimmed and in lower case; null where it is no address."""
    e = F.lower(F.trim(text(c)))
    return F.when(e.rlike(r"^[a-z0-9._%+-]+@[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,}$"), e)


def addresses(*headers: Column) -> Column:
    """Addresses of header texts in lower case, in order, each once."""
    joined = F.concat_ws(" , ", *[text(h) for h in headers])
    return F.array_distinct(F.regexp_extract_all(F.lower(joined), F.lit(r"[a-z0-9._%+-]+@[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}"), F.lit(0)))


def valid_emails(values: Column) -> Column:
    return F.array_distinct(F.array_compact(F.transform(values, normalized_email)))


def estimated_tokens(c: Column) -> Column:
    """A quarter of the characters, rounded down over a sum by the caller."""
    return F.length(text(c))

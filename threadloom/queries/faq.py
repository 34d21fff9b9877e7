"""Question and answer rules: quality, gates, relevance, answer scores, paragraphs, language.

Questions and answers are made of conversations: a turn's first words stand inside one of the forms below, chosen by its place, so
that every rule has texts that it holds for and texts that it doesn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules as fixed
from ..functions import text, tokens
from .registry import Tables, query

QUESTION_FORMS = (
    "How much does the visa cost for a family of {}?", "Could you please tell me the price and timeline of the residence permit {}?", "anything else i need to know?", "Would you like to {}?",
    "Dear Ann, can we change the date of the hotel booking {}?", "12 March 2024 is the date of {} right?", "Which documents, apostille and translation are needed for {}?", "what is your desired timeline for {}?",
    "Is that correct?", "https://example.org/visa what is it {}?", "Could you schedule a call on Friday 10:30 AM about {}?", "Please find below answers to your questions {}?",
    "What medical insurance and language test must the children take {}", "Anna, which passport do we need for {}?", "How long is the processing time of {}, and of {}, and of {}, and of {}, and how long does the whole registration take for {}?",
    "{}?", "What must we pay to the bank for the wire transfer of the retainer fee {}? ", "How is the tax of an investment paid {}?", "hello is the contract ready to be signed by us and by {}?", "Сколько стоит виза для семьи {}?",
)
ANSWER_FORMS = (
    "The visa for a family costs 2000 EUR and the residence permit takes three months to process {}.", "Dear Ann, the price is 100 EUR and the timeline of the permit is four weeks {}.", "Subject: Re: {}\nthe price is attached to this letter as you asked for it",
    "How much does the visa cost for a family of {}? The retainer fee is 900 EUR, which covers documents - translation - apostille.", "2. Documents, apostille and translation are needed, see https://example.org/list {}.",
    "Would you be available for a call tomorrow to talk about the visa and the hotel booking {}?", "Please let me know which passport you hold and whether the children need medical insurance {}.", "Short {}",
    "Our Full-Service Support Package covers the bank, the wire transfer and the registration of the family {}.", "I would like to know the same about the tax of an investment, to be honest with you {}.",
    "Thank you for your email. The contract is ready and the children need a language test and medical insurance {}.\nBest regards", "{}", "How long is it? The whole registration takes 30 days and costs 50 EUR {}",
)


def _quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_quoted, values)) + "]"


def _made_sql(forms, k: str, words: str) -> str:
    return f"replace({_list(forms)}[({k}) % {len(forms)} + 1], '{{}}', {words})"


def _made(forms, k: Column, words: Column) -> Column:
    return F.replace(F.element_at(F.array(*[F.lit(f) for f in forms]), (k % len(forms) + 1).cast("int")), F.lit("{}"), words)


def pairs(t: Tables) -> DataFrame:
    """(conv_id, turn, question, answer)"""
    words = F.array_join(F.slice(F.split(F.regexp_replace(text.text("text"), r"[ \t\n\r\f\x0b]+", " "), " "), 1, 4), " ")
    k = F.col("conv_id") * 7 + F.col("turn") * 3
    return t.conversations.select("conv_id", "turn", _made(QUESTION_FORMS, k, words).alias("question"), _made(ANSWER_FORMS, k + F.floor(F.col("conv_id") / 5), words).alias("answer"))


_WORDS = r"array_to_string(string_split(regexp_replace(coalesce(text, ''), '[ \t\n\r\f\v]+', ' ', 'g'), ' ')[1:4], ' ')"
_PAIRS = f"""pairs AS (SELECT conv_id, turn, {_made_sql(QUESTION_FORMS, 'conv_id * 7 + turn * 3', _WORDS)} AS question, {_made_sql(ANSWER_FORMS, 'conv_id * 7 + turn * 3 + conv_id // 5', _WORDS)} AS answer FROM conversations)"""


def _hit(c: str, patterns, flags: str = "i") -> str:
    return "(" + " OR ".join(f"regexp_matches({c}, {_quoted((f'(?{flags})' if flags else '') + p)})" for p in patterns) + ")"


def _all(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z'']{{3,}}')"


def _plain(c: str) -> str:
    return f"list_filter({_all(c)}, lambda x: x NOT IN ({', '.join(map(_quoted, fixed.STOP))}))"


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def _topics(c: str) -> str:
    return f"len(list_intersect(list_distinct({_all(c)}), {_list(fixed.TOPICS)}))"


def _quality_sql(c: str) -> str:
    n = f"(len({_plain(c)}) + len(regexp_extract_all(lower({c}), '[а-яё]{{3,}}')))"
    return f"""({n} * 1.5 + {_topics(c)} * 3.0 + CASE WHEN length({c}) >= 60 THEN 2 ELSE 0 END - CASE WHEN {_hit(c, fixed.GENERIC_QUESTION)} THEN 20 ELSE 0 END
 - CASE WHEN {_hit(c, fixed.TEMPLATE_QUESTION)} THEN 15 ELSE 0 END - CASE WHEN {n} < 5 THEN 5 ELSE 0 END - CASE WHEN {_topics(c)} = 0 AND {n} < 8 THEN 8 ELSE 0 END)"""


@query(f"""WITH {_PAIRS}, q AS (SELECT conv_id, turn, {_trim('question')} AS s FROM pairs), r AS (SELECT conv_id, turn, s, {_quality_sql('s')} AS quality, len({_plain('s')}) + len(regexp_extract_all(lower(s), '[а-яё]{{3,}}')) AS words FROM q)
SELECT conv_id, turn, round(quality, 6) AS quality, round(quality - CASE WHEN length(s) > 160 THEN (length(s) - 160) / 15.0 ELSE 0 END - CASE WHEN length(s) > 280 THEN 15 ELSE 0 END, 6) AS representative,
 length(s) BETWEEN 20 AND 420 AND right(s, 1) = '?' AND words >= 5 AND quality >= 4 AND NOT {_hit('s', fixed.REJECTED)} AND NOT {_hit('s', fixed.REJECTED_EXACT, '')} AND NOT {_hit('s', fixed.MANAGER_ASKS)}
 AND NOT {_hit('s', fixed.NOISE_QUESTION)} AND NOT {_hit('s', fixed.GENERIC_QUESTION)} AND NOT {_hit('s', fixed.TEMPLATE_QUESTION)} AND NOT {_hit('s', fixed.MANAGER_QUESTION)} AND NOT {_hit('s', fixed.SCHEDULING)}
 AND NOT (length(s) > 120 AND {_hit('s', fixed.HEADER_FRAGMENT)}) AS is_question FROM r""")
def question_rules(t: Tables) -> DataFrame:
    """Quality of questions, score as a representative, and the gate (rows N8, N13, P10)."""
    q = F.col("question")
    return pairs(t).select("conv_id", "turn", F.round(tokens.question_quality(q), 6).alias("quality"), F.round(tokens.representative_score(text.stripped(q)), 6).alias("representative"), tokens.looks_like_question(q).alias("is_question"))


_SPECIAL = f"list_filter(qw, lambda x: x NOT IN ({', '.join(map(_quoted, fixed.GENERIC))}))"
_PACKAGE = (r"Full-Service Support Package", r"success rate is 100%")
_RELEVANCE = f"""w AS (SELECT *, list_distinct({_plain('question')}) AS qw, list_distinct({_plain('answer')}) AS aw FROM pairs), v AS (SELECT *, {_SPECIAL} AS d, len(list_intersect(qw, aw)) AS o FROM w),
rel AS (SELECT *, CASE WHEN len(qw) = 0 THEN 0 ELSE o / greatest(least(len(qw), 12), 1) * 10.0 + len(list_intersect(d, aw)) * 4.0 - CASE WHEN len(list_intersect(d, aw)) = 0 AND len(d) >= 2 THEN 8 ELSE 0 END
 + CASE WHEN o = 0 THEN 4.0 * len(list_intersect(list_intersect(list_distinct({_all('question')}), list_distinct({_all('answer')})), {_list(fixed.TOPICS)})) ELSE 0 END
 - CASE WHEN {_hit('answer', _PACKAGE)} AND NOT {_hit('question', fixed.PACKAGE_QUESTION)} THEN 10 ELSE 0 END - CASE WHEN {_hit('answer', fixed.ANSWER_NOISE, 'im')} THEN 15 ELSE 0 END
 - CASE WHEN {_hit('left(answer, 220)', fixed.CALL_ONLY)} THEN 6 ELSE 0 END END AS relevance FROM v)"""


@query(f"""WITH {_PAIRS}, {_RELEVANCE} SELECT conv_id, turn, o AS shared, round(relevance, 6) AS relevance FROM rel""")
def relevance_overlap(t: Tables) -> DataFrame:
    """Overlap of a question with an answer (rows N9, U6, U7, U8)."""
    shared = F.size(F.array_intersect(tokens.content_words(F.col("question")), tokens.content_words(F.col("answer"))))
    return pairs(t).select("conv_id", "turn", shared.cast("long").alias("shared"), F.round(tokens.relevance(F.col("question"), F.col("answer")), 6).alias("relevance"))


@query(f"""WITH {_PAIRS}, {_RELEVANCE}, raw AS (SELECT conv_id, turn, relevance, CASE WHEN length(answer) < 50 THEN 0 ELSE least(length(answer), 1800) / 100.0 + CASE WHEN regexp_matches(answer, '[0-9]') THEN 1.5 ELSE 0 END
 + CASE WHEN regexp_matches(answer, '[-•*]\\s') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(answer, '(?i)https?://') THEN 1 ELSE 0 END + CASE WHEN {_topics('answer')} >= 2 THEN 2 ELSE 0 END
 - CASE WHEN {_hit('left(answer, 120)', (fixed.GREETING,), 'im')} OR {_hit('left(answer, 200)', (fixed.HONORIFIC,), '')} THEN 1 ELSE 0 END - CASE WHEN {_hit('left(answer, 220)', fixed.CALL_ONLY)} THEN 5 ELSE 0 END
 - CASE WHEN {_hit('left(answer, 160)', fixed.BOILERPLATE)} THEN 3 ELSE 0 END - CASE WHEN {_hit('answer', fixed.ANSWER_NOISE, 'im')} THEN 8 ELSE 0 END + 0.5 * relevance END AS score FROM rel)
SELECT conv_id, turn, round(score, 6) AS score, round(score + 1.2 * relevance, 6) AS combined FROM raw""")
def quality_score(t: Tables) -> DataFrame:
    """The score of an answer, and combined with its relevance (rows N10, N11)."""
    a, q = F.col("answer"), F.col("question")
    return pairs(t).select("conv_id", "turn", F.round(tokens.answer_score(a, q), 6).alias("score"), F.round(tokens.combined_score(a, q), 6).alias("combined"))


_ECHO = r"""e AS (SELECT *, left(regexp_replace(lower(question), '\s+', ' ', 'g'), 50) AS key, regexp_extract(answer, '(?s)^.*?\?\s+(.*)$', 1) AS tail FROM rel),
own AS (SELECT *, regexp_replace(CASE WHEN key <> '' AND contains(left(lower(answer), 160), key) AND regexp_matches(answer, '\?\s') AND length(regexp_replace(tail, '^\s+|\s+$', '', 'g')) >= 40 THEN tail ELSE regexp_replace(answer, '^\d+\.\s+', '') END, '^\s+|\s+$', '', 'g') AS ans FROM e),
bare AS (SELECT *, trim(regexp_replace(lower(question), '[^\p{L}\p{N}_]+', ' ', 'g')) AS qn, trim(regexp_replace(lower(ans), '[^\p{L}\p{N}_]+', ' ', 'g')) AS an FROM own),
sub AS (SELECT *, length(ans) >= 50 AND an <> qn AND NOT (contains(an, qn) AND length(an) < length(qn) + 35) AND NOT (right(ans, 1) = '?' AND NOT regexp_matches(answer, '(?i)\?\s+(?:Yes|No|Absolutely|Certainly|The |You |We |It |This |Regarding |Currently )')) AS substance FROM bare)"""


@query(f"""WITH {_PAIRS}, {_RELEVANCE}, {_ECHO} SELECT conv_id, turn, md5(ans) AS stripped_md5, substance,
 length(answer) >= 50 AND NOT {_hit('answer', fixed.ANSWER_NOISE, 'im')} AND NOT {_hit('answer', fixed.SIGN_OFF)} AND NOT {_hit('left(answer, 80)', (fixed.GREETING,), 'im')} AND NOT regexp_matches(answer, '(?i)^Dear\\s') AND NOT {_hit('answer', fixed.CLIENT_VOICE)}
 AND substance AND relevance >= 3 AND len(list_intersect(d, aw)) >= least(2, len(d)) AS admissible FROM sub""")
def answer_gates(t: Tables) -> DataFrame:
    """Echoes stripped, substance and admissibility of answers (rows F22, P11, P12)."""
    a, q = F.col("answer"), F.col("question")
    return pairs(t).select("conv_id", "turn", F.md5(text.strip_question_echo(a, q).cast("binary")).alias("stripped_md5"), tokens.has_substance(a, q).alias("substance"), tokens.admissible(a, q).alias("admissible"))


@query(r"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS t, len(regexp_extract_all(text, '[а-яА-ЯёЁ]{3,}')) AS c, len(regexp_extract_all(text, '[a-zA-Z'']{3,}')) AS l FROM documents)
SELECT lang, CASE WHEN c >= 3 AND c >= l * 0.4 THEN 'ru' WHEN regexp_matches(t, '[äöüßÄÖÜ]') OR regexp_matches(' ' || t || ' ', '(?i)[^\p{L}\p{N}_](wie|was|können|kann|warum|wann|über|für|und der|ich habe)[^\p{L}\p{N}_]') THEN 'de'
 WHEN regexp_matches(t, '[àâçéèêëïîôùûü]') OR regexp_matches(' ' || t || ' ', '(?i)[^\p{L}\p{N}_](bonjour|merci|comment|combien|pourquoi|est-ce)[^\p{L}\p{N}_]') THEN 'fr' ELSE 'en' END AS guess, count(*) AS n FROM w GROUP BY ALL""")
def rule_language(t: Tables) -> DataFrame:
    """Language by the ordered rules, against the given one (rows F15, F16)."""
    return t.documents.groupBy("lang", text.rule_language(F.col("text")).alias("guess")).agg(F.count("*").alias("n"))


@query(r"""WITH s AS (SELECT doc_id, unnest(string_split_regex(regexp_replace(regexp_replace(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g')), '([.!?]) ', '\1' || chr(1), 'g'), chr(1) || '$', ''), chr(1))) AS s FROM documents)
SELECT doc_id, count(*) AS sentences FROM s WHERE length(s) > 0 GROUP BY 1""")
def question_candidates(t: Tables) -> DataFrame:
    """Sentences of cleaned texts (rows N1, N2)."""
    return t.documents.select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences")).where("sentences > 0")


@query(f"""WITH {_PAIRS}, p AS (SELECT conv_id, turn, string_agg(answer, chr(10) || chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS whole, question FROM pairs)
SELECT conv_id, turn, len(list_filter(list_transform(string_split_regex(regexp_replace(whole, '^\\s+|\\s+$', '', 'g'), '\\n\\s*\\n+'), lambda x: regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')), lambda x: length(x) >= 40 AND NOT {_hit('x', fixed.ANSWER_NOISE, 'im')} AND NOT {_hit('left(x, 160)', fixed.BOILERPLATE)} AND NOT {_hit('left(x, 160)', fixed.CALL_ONLY)})) AS paragraphs
FROM p WHERE turn >= 1 AND NOT regexp_matches(whole, '(?i)best regards')""")
def answer_paragraphs(t: Tables) -> DataFrame:
    """Paragraphs of three answers in a row that may hold an answer (row F23)."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-2, 0)
    p = pairs(t).select("conv_id", "turn", F.array_join(F.collect_list("answer").over(w), "\n\n").alias("whole")).where("turn >= 1 and not whole rlike '(?i)best regards'")
    found = text.paragraphs(F.col("whole"), noise=(fixed.any_of(fixed.ANSWER_NOISE, "im"),), openings=(fixed.any_of(fixed.BOILERPLATE), fixed.any_of(fixed.CALL_ONLY)))
    return p.select("conv_id", "turn", F.size(found).cast("long").alias("paragraphs"))

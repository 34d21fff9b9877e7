"""Text cleaning as Column builders; nothing here leaves the JVM.

Patterns of a mailbox (reply markers, signatures, labels) are parameters with neutral defaults. Texts count as
empty where they are null, and every builder returns a text, never null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules as fixed
from .rules import any_of

REPLY_MARKERS = (
    r"(?im)^\s*-{2,}\s*original message\s*-{2,}",
    r"(?im)^\s*-{2,}\s*forwarded message\s*-{2,}",
    r"(?im)^\s*on .{4,200} wrote:\s*$",
    r"(?im)^\s*_{10,}\s*\n\s*from:",
    r"(?im)^\s*from:\s.+\n\s*(sent|date):\s",
)
SIGNATURE_MARK = r"(?im)^\s*(--\s*$|best regards\b|kind regards\b|sincerely\b|with regards\b|mit freundlichen\b|cordialement\b|atentamente\b)"
QUOTE_VERBS = r"(?iu)\b(wrote|writes|schrieb|écrit|a écrit|escribió|scrisse|написал\w*|пишет)\b"
SALUTATION = r"(?iu)^\s*(dear|hello|hi|good (?:morning|afternoon|evening))\b[^.!?\n]{0,60}?[,!.]\s*"
THANKS = r"(?iu)\b(?:thank you|many thanks|thanks)\b[^.!?\n]{0,80}[.!]\s*"
CHANNEL_PLACEHOLDERS = {"photo": "[photo]", "voice_message": "[voice]", "video_message": "[video]", "video_file": "[video]", "audio_file": "[audio]", "animation": "[animation]"}
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&amp;": "&"}


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def bound(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with the expression of c in the plan once, however often f names it."""
    return F.element_at(F.transform(F.array(c), lambda x: f(x)), 1)


def replaced(c: Column, *pairs: tuple[str, str]) -> Column:
    """regexp_replace, pair after pair."""
    for pattern, by in pairs:
        c = F.regexp_replace(c, pattern, by)
    return c


def stripped(c: Column) -> Column:
    """Without white space at either end, line feeds included (trim takes spaces alone)."""
    return F.regexp_replace(c, r"\A\s+|\s+\z", "")


def rstripped(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+\z", "")


def word_count(c: Column) -> Column:
    """Words between white space; 0 for blank texts, where a split would give one."""
    t = stripped(replaced(text(c), (r"\s+", " ")))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def unescaped(c: Column) -> Column:
    for name, by in ENTITIES.items():
        c = F.replace(c, F.lit(name), F.lit(by))
    return c


def html_to_text(c: Column, rich: bool = False) -> Column:
    """Markup to text: scripts and styles go, breaks and paragraphs become line feeds, at most two in a row.

    rich also breaks lines at div and li, and squeezes spaces."""
    pairs = [(r"(?is)<(script|style)\b.*?</\1\s*>", ""), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</p\s*>", "\n\n")]
    if rich:
        pairs += [(r"(?i)</(div|li|tr|h[1-6])\s*>", "\n")]
    pairs += [(r"(?s)<[^>]+>", "")]
    out = unescaped(replaced(text(c), *pairs))
    if rich:
        out = replaced(out, (r"[ \t]+", " "), (r" ?\n ?", "\n"))
    return stripped(replaced(out, (r"\n{3,}", "\n\n")))


def first_of(c: Column, patterns: Sequence[str], beyond: int = 0) -> Column:
    """Place (from 1) of the earliest first hit of a pattern; hits up to beyond are passed over; null if none."""
    places = F.array(*[F.regexp_instr(c, F.lit(p)) for p in patterns])
    return F.array_min(F.filter(places, lambda p: p > beyond))


def cut_before(c: Column, place: Column) -> Column:
    return bound(place, lambda p: F.when(p.isNull(), c).otherwise(F.substring(c, F.lit(1), p - 1)))


def strip_quoted_reply(c: Column, markers: Sequence[str] = REPLY_MARKERS) -> Column:
    """The text before the earliest reply marker and before the first line that is quoted."""
    return bound(text(c), lambda t: rstripped(cut_before(t, first_of(t, [*markers, r"(?m)^[ \t]*>"]))))


def quote_start(c: Column, markers: Sequence[str] = REPLY_MARKERS, signature: str = SIGNATURE_MARK, least: int = 20, window: int = 400) -> Column:
    """Where quoted history begins: the earliest marker past the first characters, else a signature with a marker near after it."""
    t = text(c)
    marked = first_of(t, markers, least)
    sign = F.regexp_instr(t, F.lit(signature))
    near = F.substring(t, sign, F.lit(window))
    has_marker = F.lit(False)
    for p in markers:
        has_marker = has_marker | near.rlike(p)
    return F.coalesce(marked, F.when((sign > least) & has_marker, sign))


def strip_quotes(c: Column, **options) -> Column:
    """struct<text, removed>: the text before its quotes without trailing dashes, and the bytes that went."""
    t = text(c)
    kept = replaced(rstripped(cut_before(t, quote_start(t, **options))), (r"(\s*--+\s*)+\z", ""))
    return F.struct(kept.alias("text"), (F.octet_length(t) - F.octet_length(kept)).alias("removed"))


def strip_quote_tail(c: Column, verbs: str = QUOTE_VERBS, most: int = 260) -> Column:
    """Drops a last paragraph that only introduces a quote; never the whole text."""
    t = rstripped(text(c))
    last = F.element_at(F.split(t, "\n\n"), -1)
    intro = (F.length(last) <= most) & F.endswith(rstripped(last), F.lit(":")) & last.rlike(verbs) & (F.length(last) < F.length(t))
    return F.when(intro, rstripped(F.substring(t, F.lit(1), F.length(t) - F.length(last)))).otherwise(t)


def strip_signature(c: Column, role: Column, anchor: str = SIGNATURE_MARK, address: str = r"[\w.+-]+@[\w-]+\.[\w.]+", window: int = 400, own_role: str = "manager") -> Column:
    """In texts of own_role: from the last signature up to an address within the window goes; what follows stays."""
    t = text(c)
    pattern = anchor.replace("(?im)", "").replace("^", r"(?:^|\n)")
    whole = rf"(?is)^(.*)(?:{pattern})(?=.{{0,{window}}}?{address})(?:.{{0,{window}}}?{address})(.*)$"
    hit = (role == own_role) & t.rlike(whole)
    return F.when(hit, stripped(F.regexp_replace(t, whole, "$1\n$" + str(whole.count("(") - whole.count("(?")).strip()))).otherwise(t)


def squeeze(c: Column) -> Column:
    """Blanks to one space, none at line starts, at most two line feeds, trimmed."""
    return stripped(replaced(text(c), (r"\r\n?", "\n"), (r"[ \t ]+", " "), (r"\n +", "\n"), (r"\n{3,}", "\n\n")))


def strip_quote_lines(c: Column) -> Column:
    return replaced(text(c), (r"(?m)^[ \t]*>.*(\n|\z)", ""))


def trim_reply_chain(c: Column, mark: str = SIGNATURE_MARK) -> Column:
    return bound(text(c), lambda t: stripped(cut_before(t, first_of(t, [mark]))))


def flatten(c: Column, multiline: bool = False) -> Column:
    t = stripped(text(c))
    return replaced(t, (r"[ \t]+", " "), (r"\n{3,}", "\n\n")) if multiline else stripped(replaced(t, (r"\s+", " ")))


def incoming_text(c: Column) -> Column:
    """What a sender wrote: without quoted lines, reply chain and signature."""
    return trim_reply_chain(strip_quoted_reply(strip_quote_lines(c)))


def anonymized(c: Column, names: Sequence[str] = ()) -> Column:
    """An answer on one line without reply chain, forwarded mail, sign-off, greeting, thanks, titles with names and the given names."""
    ends_with = [r"(?i)beginning of forwarded message", any_of(fixed.SIGN_OFF)]
    t = bound(trim_reply_chain(strip_quoted_reply(c)), lambda t: cut_before(t, first_of(t, ends_with)))
    first = lambda pattern: (pattern, "")
    t = replaced(t, first(r"(?i)\A" + fixed.GREETING.removeprefix("^")), first(r"\A[A-Z][a-z]+,\s+"), first(r"(?i)\bDear\s*,\s*"), first("(?i)" + fixed.THANKS_OPENING), first(fixed.HONORIFIC), first(r"\b(?:Mr\.|Ms\.|Mrs\.|Miss|Dr\.)\s+"))
    if names:
        t = replaced(t, (r"(?iu)\b(?:" + "|".join(names) + r")\b", ""))
    ends = r"^[ ,;]+|[ ,;]+$"
    return replaced(flatten(t), (ends, ""), (r"(?i)\bDear\s*$", ""), (ends, ""))


def strip_question_echo(answer: Column, question: Column) -> Column:
    """The answer after the question that it repeats at its beginning, if enough is left; else without a list number."""
    key = F.substring(F.regexp_replace(F.lower(text(question)), r"\s+", " "), 1, 50)

    def cut(a: Column) -> Column:
        rest = stripped(F.regexp_replace(a, r"(?s)\A.*?\?\s+", ""))
        echoed = (key != "") & F.contains(F.substring(F.lower(a), 1, 160), key) & a.rlike(r"\?\s") & (F.length(rest) >= 40)
        return stripped(F.when(echoed, rest).otherwise(F.regexp_replace(a, r"\A\d+\.\s+", "")))

    return bound(text(answer), cut)


def paragraphs(c: Column, least: int = 40, noise: Sequence[str] = (r"(?i)unsubscribe|confidential|sent from my",), openings: Sequence[str] = ()) -> Column:
    """Paragraphs long enough, free of noise and without the given openings; sentences where there is but one paragraph."""

    def keep(p: Column) -> Column:
        bad = F.lit(False)
        for pattern in noise:
            bad = bad | p.rlike(pattern)
        for pattern in openings:
            bad = bad | F.substring(p, 1, 160).rlike(pattern)
        return (F.length(p) >= least) & ~bad

    def split(t: Column) -> Column:
        parts = F.split(t, r"\n\s*\n+")
        return F.when(F.size(parts) > 1, parts).otherwise(F.split(t, r"(?<=[.!?])\s+(?=[A-Z0-9\"'])"))

    parts = bound(stripped(trim_reply_chain(c)), split)
    return F.filter(F.transform(parts, lambda p: flatten(p)), keep)


def sentences(c: Column) -> Column:
    """Sentences of a flattened text, split after . ! and ?"""
    t = flatten(c)
    return F.filter(F.split(t, r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def sanitize_markdown(c: Column, sources: str = r"(?is)\n+\s*(?:sources|references)\s*:.*\z") -> Column:
    """Without bold, italics, headings and a trailing list of sources."""
    return stripped(replaced(text(c), (r"\*\*(.+?)\*\*", "$1"), (r"(?<![\w*])\*([^*\n]+)\*(?![\w*])", "$1"), (r"(?m)^#{1,6}\s*", ""), (sources, "")))


def split_at(c: Column, marker: str) -> Column:
    """struct<before, after> of the marker, any case; all before where it is missing."""
    t = text(c)
    place = F.locate(marker.lower(), F.lower(t))
    whole = F.struct(stripped(t).alias("before"), F.lit("").alias("after"))
    cut = F.struct(stripped(F.substring(t, F.lit(1), place - 1)).alias("before"), stripped(F.substring(t, place + len(marker), F.length(t))).alias("after"))
    return F.when(place > 0, cut).otherwise(whole)


def letter_body(c: Column, rule: str = r"-{40,}") -> Column:
    """What stands after a rule of dashes and before quoted history."""
    t = text(c)
    parts = F.split(t, rule, 2)
    return stripped(strip_quotes(F.coalesce(F.get(parts, 1), t))["text"])


def between(c: Column, opening: str = SALUTATION, closing: str = SIGNATURE_MARK) -> Column:
    """From a salutation to a sign-off; the whole text where either is missing."""
    t = text(c)
    begin, end = F.regexp_instr(t, F.lit(opening.replace("^", "(?m)^", 1))), F.regexp_instr(t, F.lit(closing))
    return stripped(F.when((begin > 0) & (end > begin), F.substring(t, begin, end - begin)).otherwise(t))


def slug(c: Column) -> Column:
    """Lower case, runs of anything but letters and digits to one hyphen."""
    return F.trim(replaced(F.lower(text(c)), (r"[^a-z0-9]+", "-")), F.lit("-"))


def chunk_id(path: Column, prefix: str = "file") -> Column:
    return F.concat(F.lit(prefix + "__"), slug(F.regexp_replace(text(path), r"\.[A-Za-z0-9]{1,5}$", "")))


def display_subject(path: Column) -> Column:
    """A file's stem without a leading date of eight digits; underscores become spaces."""
    stem = F.regexp_replace(F.element_at(F.split(text(path), "/"), -1), r"\.[^.]*$", "")
    return stripped(replaced(stem, (r"^\d{8}[ _-]*", ""), (r"_+", " ")))


def relative_path(path: Column, root: str) -> Column:
    """path under root; an error for a path elsewhere."""
    r = root.rstrip("/") + "/"
    inside = F.startswith(path, F.lit(r))
    return F.when(inside, F.substring(path, F.lit(len(r) + 1), F.length(path))).otherwise(F.raise_error(F.concat(F.lit("not under root: "), path)))


def safe_name(c: Column) -> Column:
    return F.trim(replaced(F.lower(text(c)), (r"[^a-z0-9._@-]+", "_")), F.lit("_"))


def safe_filename(name: Column, ident: Column, most: int = 60) -> Column:
    """Letters of any script kept; the id where nothing is left."""
    cleaned = F.trim(F.substring(replaced(text(name), (r"(?U)[^\w-]+", "_")), 1, most), F.lit("_"))
    return F.when(cleaned == "", F.concat(F.lit("chat_"), ident.cast("string"))).otherwise(cleaned)


def rich_text(variant: Column) -> Column:
    """A chat export's text, given as JSON: a string, or a list of strings and objects with a text."""
    s = variant.cast("string")
    parts = F.from_json(s, "array<string>")
    joined = F.array_join(F.transform(parts, lambda p: F.coalesce(F.get_json_object(p, "$.text"), p)), "")
    return F.when(F.startswith(F.ltrim(s), F.lit("[")), F.coalesce(joined, F.lit(""))).otherwise(F.coalesce(s, F.lit("")))


def media_placeholder(media_type: Column, photo: Column, file_name: Column, contact: Column) -> Column:
    """What stands for a message's media; null for stickers and contact cards."""
    kind = F.lit(None).cast("string")
    for name, label in CHANNEL_PLACEHOLDERS.items():
        kind = F.coalesce(kind, F.when(media_type == name, label))
    shown = F.coalesce(kind, F.when(photo.isNotNull(), "[photo]"), F.when(file_name.isNotNull(), F.concat(F.lit("[file: "), file_name, F.lit("]"))))
    return F.when((media_type == "sticker") | contact.isNotNull(), None).otherwise(shown)


def message_body(body: Column, placeholder: Column) -> Column:
    t = stripped(text(body))
    return F.coalesce(F.when(t != "", t), placeholder)


def numbered_sections(c: Column) -> Column:
    """map<number, text> of the sections under numbered headings (## 3. Title)."""
    parts = F.filter(F.split(text(c), r"(?m)^(?=##\s+\d+\.)"), lambda p: p.rlike(r"^##\s+\d+\."))
    entry = lambda p: F.struct(F.regexp_extract(p, r"^##\s+(\d+)\.", 1).cast("int").alias("key"), stripped(p).alias("value"))
    return F.map_from_entries(F.transform(parts, entry))


def renumbered(c: Column, shift: int) -> Column:
    """Numbered headings moved by shift."""
    head = r"(?s)^##\s+(\d+)\."
    parts = F.split(text(c), r"(?m)^(?=##\s+\d+\.)")
    move = lambda p: F.when(p.rlike(head), F.concat(F.lit("## "), (F.regexp_extract(p, head, 1).cast("int") + shift).cast("string"), F.regexp_replace(p, r"^##\s+\d+", ""))).otherwise(p)
    return F.array_join(F.transform(parts, move), "")


def replaced_all(c: Column, literals: dict[str, str]) -> Column:
    for old, new in literals.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def inserted_before(c: Column, anchor: str, block: str, marker: str) -> Column:
    """block before the anchor, at the end without one, and unchanged where the marker is there already."""
    t = text(c)
    place = F.locate(anchor, t)
    put = F.when(place > 0, F.concat(F.substring(t, F.lit(1), place - 1), F.lit(block), F.substring(t, place, F.length(t)))).otherwise(F.concat(t, F.lit(block)))
    return F.when(F.contains(t, F.lit(marker)), t).otherwise(put)


def template_literal(c: Column) -> Column:
    """Escaped for a JavaScript template literal."""
    return replaced_all(text(c), {"\\": "\\\\", "`": "\\`", "${": "\\${"})


def truncated(c: Column, most: int, marker: str = "... [cut]") -> Column:
    t = text(c)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - len(marker)), F.lit(marker))).otherwise(t)


def head_and_tail(c: Column, budget: int, marker: str = "\n[...]\n", head: float = 0.6) -> Column:
    """The first 60 % and the last 40 % of a budget around a marker."""
    t = text(c)
    first, last = int(budget * head), budget - int(budget * head)
    return F.when(F.length(t) <= budget, t).otherwise(F.concat(F.substring(t, 1, first), F.lit(marker), F.right(t, F.lit(last))))


def text_chunks(c: Column, size: int = 4096) -> Column:
    """Pieces of at most size, cut at the last paragraph, line or space that fits."""
    pattern = rf"(?s).{{1,{size}}}(?=\n\n|\z)|.{{1,{size}}}(?=\n|\z)|.{{1,{size}}}(?=\s|\z)|.{{1,{size}}}"
    pieces = F.transform(F.regexp_extract_all(text(c), F.lit(pattern), F.lit(0)), lambda p: stripped(replaced(p, (r"^\n+|\n+$", ""))))
    return F.filter(pieces, lambda p: p != "")


def rule_language(c: Column) -> Column:
    """ru, de, fr or en, by the first rule that holds: Cyrillic words, then diacritics or small words of German, then of French."""
    t = stripped(text(c))
    cyrillic, latin = F.regexp_count(t, F.lit("[а-яА-ЯёЁ]{3,}")), F.regexp_count(t, F.lit("[a-zA-Z']{3,}"))
    # fixed values of the surveyed rule
    german = t.rlike("[äöüßÄÖÜ]") | t.rlike(r"(?iu)(?<![\p{L}\p{N}_])(?:wie|was|können|kann|warum|wann|über|für|und der|ich habe)(?![\p{L}\p{N}_])")
    french = t.rlike("[àâçéèêëïîôùûü]") | t.rlike(r"(?iu)(?<![\p{L}\p{N}_])(?:bonjour|merci|comment|combien|pourquoi|est-ce)(?![\p{L}\p{N}_])")
    return F.when((cyrillic >= 3) & (cyrillic >= latin * 0.4), "ru").when(german, "de").when(french, "fr").otherwise("en")

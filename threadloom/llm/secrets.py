"""Secret scans on DataFrame functions, with a random forest that drops false positives.

What could be a secret (every value after a credential's name, in its word or the words before; a login in an address; a run of
token characters with a digit; a known prefix) becomes a candidate with features of its value and of the neighbouring words. A random forest, trained
here from labelled findings, turns into a SQL expression and scores them. Private-key blocks are found by their armour.

Everything works within a row: a text is split only where it has a digit, a credential's name or a key block.

Cases: null and empty texts have no findings; repeated rows each give theirs; ties of the forest (a score of exactly the cut)
count as secrets; other columns are kept, whatever their names; an empty table stays empty; texts are scanned whole, however long.
"""

from __future__ import annotations

import base64
import random
import re
from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import unused

CUT = 0.5
TREES, DEPTH, LEAST_ROWS, SEED = 15, 5, 4, 11
MASK = "<secret>"
SHORT = 8

# Names of credentials, words that name harmless codes, and known prefixes of issued keys.
CREDENTIAL = r"passw(or)?d|passwd|passphrase|pwd|secret|token|api_?-?key|access_?-?key|private_?-?key|auth|bearer|credential"
HARMLESS = r"^\W*(sha1?|sha256|md5|commit|checksum|hash|digest|uuid|guid|version|build|revision|rev|phone|tel|fax|card|order|invoice|isbn|issn|doi|ref|id|serial|model|sku|tracking)\W*$"
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{20,}$|^sk-[A-Za-z0-9_-]{16,}$|^xox[abprs]-[A-Za-z0-9-]{10,}$|^AIza[A-Za-z0-9_-]{30,}$|^eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*$|^glpat-[A-Za-z0-9_-]{16,}$"
WORDS = (
    "the and ing tion ent ess for that with from this have not are was were been which their there about would other into time more some these than "
    "data file name user page index image photo video list test main home item code text info date year month report version release draft final table "
    "model server client service request response config default value number string object class method function module package section chapter"
).split()
WORDS = tuple(WORDS)
# What follows a credential's name in a word (to the next pair), a login in an address, a word that ends in a name, and words between a name and its value.
KEY = rf"(?i)(?:{CREDENTIAL})[\w.-]*+[\"'`\])\\]*+(?:=>|[=:]++)"
PAIR = KEY + r"""[(\[{<\\]*+(?:"[^"]+"|'[^']+'|`[^`]+`|(?:(?![&;,|][\w.\\\"'\[\]{-]*+[=:])[^\"'`\s])++)"""
LOGIN = r"(://[^\s/:@]*+:)([^\s/]+)@"
OTHER_NAME = r"(?i)author(?!iz)|authent|secretar|tokens|token_count"
NAMED = rf"(?i)(?:{CREDENTIAL})[\w.-]*+[\"'`\])\\]*+[=:>]*+$"
BETWEEN = r"(?i)^(?:[=:>-]+|(?:is|was|are|bearer|basic)[=:]*)$"
ARMOUR = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?-----END [A-Z ]*PRIVATE KEY-----"

FEATURES = ("length", "digits", "upper", "lower", "symbols", "runs", "distinct", "hex", "dictionary", "vowel_steps", "path", "slashes", "dots", "credential", "harmless", "assigned", "number_like", "address", "issued", "named", "quoted", "login", "classes", "other_name")


def candidates(text: Column) -> Column:
    """array<struct<at, value, own, before, after, named, quoted>>: value is the candidate, own what stands before it in its word.

    Every value that follows a credential's name is one, whatever its length or characters: each pair of a word, the password of
    an address, and (named) a word after the name, with or without a sign or a verb between. Of other words, those with a run."""
    near = lambda words, i: F.coalesce(F.get(words, i), F.lit(""))

    def cleaned(rest: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(rest, r"([#*$%&!|~])\1{2,}$", ""), r"^[\"'`(\[{<]+|[\"'`)\]}>,;.!?\\]+$", "")

    def value(at: Column, own: Column, rest: Column, named: Column) -> Column:
        inner = F.regexp_extract(rest, r"^[(\[{<\\]*([\"'`])([^\"'`]+)\1", 2)
        bare = F.when(inner != "", F.regexp_replace(inner, r"\\+$", "")).otherwise(cleaned(rest))
        return F.struct(at.alias("at"), bare.alias("value"), own.alias("own"), F.lit("").alias("before"), F.lit("").alias("after"), named.alias("named"), (inner != "").alias("quoted"))

    def of(words: Column, w: Column, i: Column) -> Column:
        no = F.lit(False)
        key = lambda m: F.regexp_extract(m, f"^{KEY}", 0)
        pairs = F.transform(F.regexp_extract_all(w, F.lit(PAIR), F.lit(0)), lambda m: value(i, key(m), F.substr(m, F.length(key(m)) + 1), no))
        logins = F.transform(F.regexp_extract_all(w, F.lit(LOGIN), F.lit(0)), lambda m: value(i, F.regexp_extract(m, LOGIN, 1), F.regexp_extract(m, LOGIN, 2), no))
        left = F.regexp_replace(F.regexp_replace(w, PAIR, ""), LOGIN, "://")
        prior = near(words, i - 1)
        after_name = (prior.rlike(NAMED) | (prior.rlike(BETWEEN) & near(words, i - 2).rlike(NAMED))) & ~w.rlike(BETWEEN)
        alone = lambda rest, named: F.array(value(i, F.lit(""), rest, named))
        paired = w.rlike("[=:]") & (w.rlike(PAIR) | w.rlike(LOGIN))
        return F.when(paired, F.concat(pairs, logins, alone(left, no))).when(after_name, alone(F.regexp_replace(w, "^[=:>]+", ""), F.lit(True))).otherwise(plain(w, i))

    def plain(w: Column, i: Column) -> Column:
        # only such words can pass as a run or an issued key
        return F.when(w.rlike("[A-Za-z0-9+/_=~-]{10}|eyJ"), F.array(value(i, F.lit(""), w, F.lit(False)))).otherwise(nothing())

    def possible(c: Column) -> Column:
        run = c["value"].rlike(r"[A-Za-z0-9+/_=~-]{10,}") & c["value"].rlike("[0-9]")
        return (c["value"] != "") & (c["named"] | (c["own"] != "") | run | c["value"].rlike(ISSUED))

    def found(words: Column, each) -> Column:
        picked = F.filter(F.flatten(F.transform(words, each)), possible)
        return F.transform(picked, lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), c["own"].alias("own"), F.concat_ws(" ", near(words, c["at"] - 2), near(words, c["at"] - 1)).alias("before"), near(words, c["at"] + 1).alias("after"), c["named"].alias("named"), c["quoted"].alias("quoted")))

    nothing = lambda: F.expr("cast(array() as array<struct<at:int,value:string,own:string,before:string,after:string,named:boolean,quoted:boolean>>)")
    # a transform over one element, so that its words are split once
    split = F.array(F.split(F.trim(text), r"\s+"))
    with_names = F.transform(split, lambda words: found(words, lambda w, i: of(words, w, i)))[0]
    return F.when(text.rlike(rf"(?i)({CREDENTIAL})") | text.rlike(LOGIN), with_names).when(text.rlike("[0-9]"), F.transform(split, lambda words: found(words, plain))[0]).otherwise(nothing())


def dictionary(rank_file: str, most: int = 5000) -> tuple[str, ...]:
    """The first words, by rank, of three letters a-z and more that begin with a space in a file of byte-level token ranks."""
    with open(rank_file, "rb") as f:
        tokens = (base64.b64decode(line.split()[0]) for line in f if line.strip())
        words = dict.fromkeys(t[1:].decode("ascii").lower() for t in tokens if re.fullmatch(rb" [A-Za-z][a-z]{2,}", t))
        return tuple(words)[:most]


def features(c: Column, words: tuple[str, ...] = WORDS) -> Column:
    """The struct of FEATURES of a candidate; words is the dictionary that letters of it may be covered by."""
    v = c["value"]
    n = F.greatest(F.length(v), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")) / n
    flag = lambda condition: condition.cast("double")
    prior = F.substring_index(c["before"], " ", -1)
    held = F.lit(" " + " ".join(words) + " ")
    runs_of_letters = F.regexp_extract_all(v, F.lit("[A-Z]?[a-z]{2,}|[A-Z]{3,}"), F.lit(0))
    known = F.filter(runs_of_letters, lambda w: F.contains(held, F.concat(F.lit(" "), F.lower(w), F.lit(" "))))
    covered = F.length(F.array_join(known, ""))
    values = (
        n,
        share("[0-9]"),
        share("[A-Z]"),
        share("[a-z]"),
        share("[^A-Za-z0-9]"),
        runs,
        F.size(F.array_distinct(F.split(v, ""))) / n,
        flag(v.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        covered / n,
        F.regexp_count(F.lower(v), F.lit("[aeiouy][bcdfghjklmnpqrstvwxz]")) / n,
        flag(v.rlike(r"^(\.{0,2}/|~/|[A-Za-z]:\\)[\w.-]|^[\w.-]+/[\w./-]+$|\.[A-Za-z][A-Za-z0-9]{1,3}$")),
        F.regexp_count(v, F.lit(r"[/\\]")).cast("double"),
        F.regexp_count(v, F.lit(r"\.")).cast("double"),
        flag(F.concat_ws(" ", c["own"], c["before"]).rlike(rf"(?i)({CREDENTIAL})")),
        flag(F.exists(F.split(F.concat_ws(" ", c["before"], c["own"]), r"\s+"), lambda w: w.rlike("(?i)" + HARMLESS))),
        flag((c["own"] != "") | prior.rlike("[=:]$")),
        flag(v.rlike(r"^[0-9.,:/+()x-]+$")),
        flag(v.rlike(r"@|://|^www\.|^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        flag(v.rlike(ISSUED)),
        flag(c["named"]),
        flag(c["quoted"]),
        flag(c["own"].startswith("://")),
        flag(v.rlike("[a-z]")) + flag(v.rlike("[A-Z]")) + flag(v.rlike("[0-9]")) + flag(v.rlike("[^A-Za-z0-9]")),
        flag(F.concat_ws(" ", c["own"], c["before"]).rlike(OTHER_NAME)),
    )
    return F.struct(*[x.cast("double").alias(name) for x, name in zip(values, FEATURES, strict=True)])


@cache
def labelled_findings(rows: int = 900, seed: int = SEED, words: tuple[str, ...] = WORDS) -> tuple[tuple[str, int], ...]:
    """(text of one finding, label): issued and assigned secrets, and look-alikes such as hashes, paths, codes and numbers."""
    rng = random.Random(seed)
    hexed = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    mixed = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    upper = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=n))
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    invented = lambda: "".join(rng.choices(("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti"), k=rng.randint(2, 5)))
    word = lambda: rng.choice(words) if rng.random() < 0.3 else invented()
    name = lambda: rng.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "API_KEY", "client_secret", "Password"))
    value = lambda: rng.choice((hexed(rng.randint(12, 64)), mixed(rng.randint(12, 48)), mixed(rng.randint(8, 14)) + rng.choice("!#$%_-"), upper(rng.randint(16, 32)) + digits(2)))
    human = lambda: rng.choice((invented() + digits(rng.randint(1, 3)) + rng.choice("!#$%&@_-.") + rng.choice(("", mixed(1))), invented().title() + rng.choice("0134578") + invented() + rng.choice(("", "&", "!", "$")) + digits(rng.randint(1, 2)), mixed(rng.randint(6, 10)) + digits(1), invented()[:2] + digits(1) + invented() + word().title() + digits(2)))
    letters = lambda: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", k=rng.randint(12, 28)))
    phrase = lambda: word() + invented() + invented() + word()
    any_value = lambda: rng.choice((value, human, human, letters))()
    issued = lambda: rng.choice(("AKIA" + upper(15) + "7", "ghp_" + mixed(36), "sk-" + mixed(32), "xoxb-" + digits(11) + "-" + mixed(20), "AIza" + mixed(35), "eyJ" + mixed(20) + "." + mixed(40) + "." + mixed(30)))
    secret = (
        lambda: f"{name()}={value()}",
        lambda: f"{name()}: {value()}",
        lambda: f'{name()} = "{value()}"',
        lambda: f"{name()}='{value()}'",
        issued,
        lambda: f"{name()}={issued()}",
        lambda: f"{name()} = {human()}",
        lambda: f"{name()}: {human()}",
        lambda: f"{name()}={human()}",
        lambda: f'{name()} = "{phrase()}"',
        lambda: f'{name()}: "{human()}"',
        lambda: f"{name()} = {letters()}",
        lambda: f"{name()} {rng.choice(('is', 'was', 'is:'))} {human()}",
        lambda: f'{{"user":"{word()}","{name()}":"{any_value()}"}}',
        lambda: f"user={word()};{name()}={any_value()}",
        lambda: f"https://{word()}.example.org/{word()}?user={word()}&{name()}={value()}",
        lambda: f"{rng.choice(('postgres', 'mysql', 'amqp', 'https'))}://{word()}:{rng.choice((any_value, phrase, invented))()}@{word()}/{word()}",
        lambda: f"Authorization: {rng.choice(('Bearer', 'Basic'))} {value()}",
    )
    harmless = (
        lambda: f"{rng.choice(('commit', 'sha1', 'sha256', 'md5', 'checksum', 'hash', 'digest', 'revision'))} {rng.choice(('', ': ', '= '))}{hexed(rng.choice((32, 40, 64)))}",
        lambda: f"{rng.choice(('uuid', 'id', 'guid', 'see'))} {hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}",
        lambda: hexed(8) + "-" + hexed(4) + "-4" + hexed(3) + "-a" + hexed(3) + "-" + hexed(12),
        lambda: digits(rng.randint(10, 20)),
        lambda: f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}",
        lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
        lambda: f"20{digits(2)}-0{digits(1)}-1{digits(1)}T1{digits(1)}:2{digits(1)}:00",
        lambda: f"{invented()}.{digits(2)}@{word()}{digits(1)}.example.com",
        lambda: f"https://{word()}.example.org/{word()}/{digits(4)}/{word()}-{digits(2)}.html",
        lambda: f"/{word()}/{word()}/{word()}_{digits(3)}/{word()}{digits(2)}.{rng.choice(('py', 'txt', 'jpg', 'csv'))}",
        lambda: f"{word()}_{word()}_{digits(rng.randint(1, 6))}",
        lambda: f"{word()}-{word()}-{word()}-{digits(rng.randint(1, 4))}",
        lambda: f"{word().title()}{word().title()}{word().title()}{digits(rng.randint(1, 3))}",
        lambda: f"{rng.choice(('version', 'v', 'build', 'release'))} {digits(1)}.{digits(2)}.{digits(3)}-{word()}{digits(4)}",
        lambda: f"{rng.choice(('order', 'invoice', 'isbn', 'tracking', 'serial', 'ref'))} {upper(3)}-{digits(rng.randint(6, 12))}",
        lambda: f"{name()}: {rng.choice(('required', 'changeme?', 'optional', 'expired', 'invalid', 'rejected', 'missing', 'the_' + invented()))}",
        lambda: f"{name()} = {rng.choice(('getenv', 'None,', 'null', 'undefined', 'request.headers', 'args.token', 'your-' + invented(), 'xxxxxxxxxxxx', '************', 'os.environ'))}",
        lambda: f"{digits(1)}{digits(2)}.{digits(2)}.{digits(2)}.{digits(3)}",
        lambda: "=" * rng.randint(8, 40) + digits(1),
        lambda: f"{word()}{digits(2)}x{digits(4)}px_{word()}",
        lambda: f"{name()} {rng.choice(('is', 'was'))} {word()}",
        lambda: f"{name()} {word()}",
        lambda: f"{rng.choice(('tokens', 'token_count', 'authors', 'secretary', 'authority', 'authentic', 'token', 'secrets'))} {rng.choice(('', 'is '))}{word()}",
        lambda: f"{rng.choice(('author', 'Author', 'authors', 'secretary', 'auth'))}: {rng.choice((invented().title(), word()))}",
        lambda: f"{rng.choice(('tokens', 'max_tokens', 'token_count', 'n_tokens', 'tokens_used'))}{rng.choice((': ', '=', ' = ', ' '))}{digits(rng.randint(1, 5))}",
        lambda: f'{{"{name()}":"{rng.choice(("", "string", "required", "null", word()))}"}}',
        lambda: f"{name()}={rng.choice(('true', 'false', 'none', 'null', 'required', word()))}",
        lambda: f"{name()}, {word()}",
        lambda: f"{name()} = {word()}",
    )
    out = []
    for i in range(rows):
        label = i % 2
        kind = (secret if label else harmless)[(i // 2) % len(secret if label else harmless)]
        out.append((f"{word()} {word()} {kind()} {word()}", label))
    return tuple(out)


def _split(x: np.ndarray, y: np.ndarray, columns: np.ndarray):
    """(gini, column, threshold) of the best cut, or None."""
    best = None
    for c in columns:
        order = np.argsort(x[:, c], kind="stable")
        v, ones = x[order, c], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] > v[:-1])
        at = at[(at + 1 >= LEAST_ROWS) & (len(y) - at - 1 >= LEAST_ROWS)]
        if not len(at):
            continue
        left, right = at + 1.0, len(y) - at - 1.0
        p, q = ones[at] / left, (ones[-1] - ones[at]) / right
        gini = left * p * (1 - p) + right * q * (1 - q)
        k = int(gini.argmin())
        if best is None or gini[k] < best[0] - 1e-12:
            best = (float(gini[k]), int(c), float((v[at[k]] + v[at[k] + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int = DEPTH):
    """A tree: a probability, or (column, threshold, low side, high side)."""
    if depth == 0 or len(y) < 2 * LEAST_ROWS or y.min() == y.max():
        return float(y.mean())
    width = max(1, int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    cut = _split(x, y, rng.choice(x.shape[1], width, replace=False)) or _split(x, y, np.arange(x.shape[1]))
    if cut is None:
        return float(y.mean())
    _, c, t = cut
    low = x[:, c] <= t
    return c, t, grow(x[low], y[low], rng, depth - 1), grow(x[~low], y[~low], rng, depth - 1)


def train_forest(x: np.ndarray, y: np.ndarray, trees: int = TREES, seed: int = SEED) -> list:
    rng = np.random.default_rng(seed)
    samples = (rng.integers(0, len(y), len(y)) for _ in range(trees))
    return [grow(x[s], y[s], rng) for s in samples]


def forest_column(forest: list, f: Column) -> Column:
    """The forest's mean probability as an expression over the struct f of FEATURES."""

    def of(tree) -> Column:
        if isinstance(tree, float):
            return F.lit(tree)
        c, t, low, high = tree
        return F.when(f[FEATURES[c]] <= F.lit(t), of(low)).otherwise(of(high))

    total = of(forest[0])
    for tree in forest[1:]:
        total = total + of(tree)
    return F.round(total / F.lit(float(len(forest))), 6)


_forests: dict[tuple, list] = {}


def forest(spark: SparkSession, findings: tuple[tuple[str, int], ...] | None = None, words: tuple[str, ...] = WORDS) -> list:
    """A forest trained from labelled findings (bounded, 900 by default); their features come from the same expressions as a scan's."""
    findings = findings or labelled_findings(words=words)
    if (findings, words) not in _forests:
        quoted = lambda t: "'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'"
        rows = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({quoted(t)}, {y})" for t, y in findings) + " AS t(text, label)")
        found = rows.select("label", F.explode(F.transform(candidates(F.col("text")), lambda c: features(c, words))).alias("f")).collect()
        x = np.array([[r["f"][name] for name in FEATURES] for r in found])
        _forests[findings, words] = train_forest(x, np.array([float(r["label"]) for r in found]))
    return _forests[findings, words]


def judged(spark: SparkSession, findings: tuple[tuple[str, int], ...], cut: float = CUT, words: tuple[str, ...] = WORDS) -> dict[str, int]:
    """hits, misses, false_alarms and rejected of labelled findings by their text; a secret without a candidate is a miss."""
    trees = forest(spark, words=words)
    rows = spark.createDataFrame(list(findings), "text string, label int")
    secret = F.exists(F.transform(candidates(F.col("text")), lambda c: features(c, words)), lambda f: forest_column(trees, f) >= cut)
    n = {(r["label"], r["secret"]): r["n"] for r in rows.groupBy("label", secret.alias("secret")).agg(F.count("*").alias("n")).collect()}
    return {name: n.get(key, 0) for name, key in (("hits", (1, True)), ("misses", (1, False)), ("false_alarms", (0, True)), ("rejected", (0, False)))}


def scan(docs: DataFrame, text_col: str = "text", cut: float = CUT, words: tuple[str, ...] = WORDS, into: str = "__findings") -> DataFrame:
    """docs with the column into: array<struct<at, kind, value, score, is_secret, lead>>; at is the place of its word, from 0, and lead what stands before the value."""
    trees = forest(docs.sparkSession, words=words)
    text = F.coalesce(F.col(text_col), F.lit(""))
    prior = lambda c: F.substring_index(c["before"], " ", -1)
    found = F.transform(candidates(text), lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), F.when(c["named"], prior(c)).otherwise(c["own"]).alias("lead"), features(c, words).alias("f")))
    kind = lambda f: F.when(f["issued"] == 1, "issued").when(f["assigned"] == 1, "assigned").when(f["named"] == 1, "named").otherwise("run")
    scored = F.transform(found, lambda c: F.struct(c["at"].alias("at"), c["value"].alias("value"), c["lead"].alias("lead"), kind(c["f"]).alias("kind"), forest_column(trees, c["f"]).alias("score")))
    judged_words = F.transform(scored, lambda c: F.struct(c["at"].alias("at"), c["kind"].alias("kind"), c["value"].alias("value"), c["score"].alias("score"), (c["score"] >= cut).alias("is_secret"), c["lead"].alias("lead")))
    none = F.expr("cast(array() as array<string>)")
    keys = F.when(F.contains(text, F.lit("PRIVATE KEY-----")), F.regexp_extract_all(text, F.lit(ARMOUR), F.lit(0))).otherwise(none)
    blocks = F.transform(keys, lambda v: F.struct(F.lit(-1).alias("at"), F.lit("private_key").alias("kind"), v.alias("value"), F.lit(1.0).alias("score"), F.lit(True).alias("is_secret"), F.lit("").alias("lead")))
    return docs.withColumn(into, F.concat(blocks, judged_words))


def redacted(docs: DataFrame, text_col: str = "text", cut: float = CUT, words: tuple[str, ...] = WORDS) -> DataFrame:
    """docs, all rows and columns, with every value found to be a secret replaced in its text; longer values go first.

    Values of under SHORT characters are replaced only behind what stood before them, as they may be words of the text."""
    into = unused("__findings", docs)
    scanned = scan(docs, text_col, cut, words, into)
    literal = lambda c: F.concat(F.lit("\\Q"), F.replace(c, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    behind = lambda s: F.concat(F.lit("("), literal(s["lead"]), F.lit("[\\s\"'`(\\[{<\\\\=:>]*)"), literal(s["v"]), F.lit("(?![A-Za-z0-9])"))
    mask = lambda t, s: F.when(F.length(s["v"]) < SHORT, F.regexp_replace(t, behind(s), F.lit("$1" + MASK))).otherwise(F.replace(t, s["v"], F.lit(MASK)))
    secret = F.transform(F.filter(into, lambda x: x["is_secret"]), lambda x: F.struct((-F.length(x["value"])).alias("n"), x["value"].alias("v"), F.when(F.length(x["value"]) < SHORT, x["lead"]).otherwise("").alias("lead")))
    secret = F.array_sort(F.array_distinct(secret))
    clean = F.when(F.size(secret) > 0, F.aggregate(secret, F.col(text_col), mask)).otherwise(F.col(text_col))
    return scanned.withColumn(text_col, clean).select(*[F.col(f"`{c}`") for c in docs.columns])

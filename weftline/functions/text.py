"""Text functions, Column to Column; all run inside the JVM. stem_word() is stem() in Python."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that search passes over.
STOPWORDS = (
    "a an and are as at be but by for from if in into is it no not of on or such that the their then there "
    "these they this to too was will with you your"
).split()

# Words that the analysis of mails passes over.
MAIL_STOPWORDS = (
    "i me my we our you your he him his she her it its they them their what which who this that these those am is are was were "
    "be been being have has had do does did a an the and but if or as of at by for with to from in on up so no not can will just "
    "now may please let know would could also get like well hi dear regards best thanks thank email team shall going sure need"
).split()

# Endings that are cut off, in the order they are tried.
SUFFIXES = ("ingly", "edly", "ing", "ed", "ly", "es", "s", "ment")

# Units that suggestions leave out.
SUGGESTION_SKIP = ("ml", "gm", "g", "kg", "le")

#: Named characters of HTML; the names themselves come with Python.
ENTITIES = {**{name: chr(code) for name, code in name2codepoint.items()}, "apos": "'"}


def collapse(x: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, r"(?U)\s+", " "))


def _character(name: Column) -> Column:
    """What an entity's name or number stands for, else null. Numbers that are no character stand for U+FFFD, as 0 does."""
    digits = F.regexp_extract(name, "^#([0-9]{1,7})$", 1)
    hexes = F.regexp_extract(name, "^#[xX]([0-9a-fA-F]{1,6})$", 1)
    code = F.when(digits != "", digits.try_cast("int")).when(hexes != "", F.conv(hexes, 16, 10).try_cast("int"))
    known = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    made = F.decode(F.unhex(F.lpad(F.hex(F.when(known, code).otherwise(0xFFFD)), 8, "0")), "UTF-32")
    return F.when(code.isNotNull(), made).otherwise(F.try_element_at(F.create_map(*[F.lit(x) for e in ENTITIES.items() for x in e]), name))


def unescape(x: Column) -> Column:
    """Entities with a semicolon as characters, each once; other ampersands stay. Texts without an ampersand aren't looked at."""

    def piece(p: Column) -> Column:
        name = F.regexp_extract(p, "^&(#?[0-9a-zA-Z]+);", 1)
        c = F.when(name != "", _character(name))
        return F.when(c.isNull(), p).otherwise(F.concat(c, F.substring(p, F.length(name) + 3, F.length(p))))

    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(F.split(x, "(?=&)"), piece), "")).otherwise(x)


def clean_text(x: Column) -> Column:
    """Null as empty, entities unescaped, white space collapsed."""
    return collapse(unescape(F.coalesce(x.cast("string"), F.lit(""))))


def clean_plain(x: Column) -> Column:
    """clean_text() without entities."""
    return collapse(F.coalesce(x.cast("string"), F.lit("")))


def stem(token: Column) -> Column:
    """Cuts off the first ending that fits and leaves three characters at least; once only."""
    fits = [(F.endswith(token, F.lit(s)) & (F.length(token) > len(s) + 2), F.expr(f"-{len(s)}")) for s in SUFFIXES]
    cut = reduce(lambda c, f: c.when(f[0], f[1]), fits[1:], F.when(*fits[0])).otherwise(F.lit(0))
    return F.left(token, F.length(token) + cut)


def stem_word(token: str) -> str:
    """stem() of a str."""
    return next((token[: -len(s)] for s in SUFFIXES if token.endswith(s) and len(token) > len(s) + 2), token)


def _words(text: Column, letters: str, stopwords: Sequence[str], least: int = 1) -> Column:
    """Runs of letters (a class of characters) in lower-case text that are no stopwords: one pass of one pattern, without a function for each word."""
    stop = "|".join(sorted(stopwords, key=lambda w: (-len(w), w)))
    return F.regexp_extract_all(F.lower(text), F.lit(f"(?<!{letters})(?!(?:{stop})(?!{letters}))({letters}{{{least},}})"), F.lit(1))


def raw_tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Runs of a-z and 0-9 that aren't stopwords, before stemming."""
    return _words(unescape(F.coalesce(text.cast("string"), F.lit(""))), "[a-z0-9]", stopwords)


def tokens(text: Column, stopwords: Sequence[str] = STOPWORDS) -> Column:
    """Stems of the runs of a-z and 0-9 that aren't stopwords."""
    return F.transform(raw_tokens(text, stopwords), stem)


def normalize_term(term: Column) -> Column:
    bare = F.regexp_replace(F.lower(term), "[^a-z0-9]+", "")
    return F.when(bare.isin("", *STOPWORDS), F.lit("")).otherwise(stem(bare))


def mail_words(x: Column) -> Column:
    """Words of a-z with three letters or more, without stopwords, in order."""
    return _words(F.coalesce(x, F.lit("")), "[a-z]", MAIL_STOPWORDS, 3)


def clean_mail(x: Column) -> Column:
    return F.array_join(mail_words(x), " ")


def suggestion_words(x: Column) -> Column:
    """Words as they are written, without stopwords, units and numbers."""
    return F.filter(raw_tokens(x, [*STOPWORDS, *SUGGESTION_SKIP]), lambda w: ~F.rlike(w, F.lit("^[0-9]+$")))


def displayable(term: Column) -> Column:
    return F.rlike(term, F.lit(r"\p{L}"))


def format_compact(x: Column) -> Column:
    """1.5K, 2M, 3B with one decimal at most; below a thousand a whole number."""
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.1f", (x / d).cast("double")), r"\.0$", ""), F.lit(unit))
    size = F.abs(x)
    return F.when(size >= 1e9, short(1e9, "B")).when(size >= 1e6, short(1e6, "M")).when(size >= 1e3, short(1e3, "K")).otherwise(F.format_number(F.bround(x.cast("double"), 0), 0))


# Outcomes and the scores they start at.
DECISIONS = ((0.65, "Raise Recommended"), (0.45, "Under Review"))
UNDECIDED = "Not Recommended"


def decide(score: Column) -> Column:
    return F.when(score >= DECISIONS[0][0], DECISIONS[0][1]).when(score >= DECISIONS[1][0], DECISIONS[1][1]).otherwise(UNDECIDED)


def flag_score(flag: Column) -> Column:
    """Score of a behaviour flag, by how it begins and by words in it; letter case counts."""
    has = lambda *words: reduce(lambda a, b: a | b, [F.contains(flag, F.lit(w)) for w in words])
    good, bad = F.startswith(flag, F.lit("Positive")), F.startswith(flag, F.lit("Negative"))
    return F.when(good & has("Exceptional", "Brave", "Exemplary"), 1.2).when(good, 1.0).when(bad & has("Abuse", "Recurring", "Culture"), -1.4).when(bad, -1.0).otherwise(0.0)

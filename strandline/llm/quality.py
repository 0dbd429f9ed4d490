"""Quality rules, line first: each line is judged by its punctuation, as navigation and as boilerplate; lines that fail are removed,
and a document that loses too much of its text so is rejected. Column functions over one row at a time: no shuffle, no Python.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import WORD

#: Words of a window; a document is bad if more than MAX_REPEATED of 100 words lie in windows that it has twice, or has few words.
WINDOW, MAX_REPEATED, MIN_WORDS = 8, 30, 20
#: A document is rejected when it loses more than so many of 100 characters in words with its lines.
MAX_LOST = 50

BLANK, SYMBOL = r"[\x20\x09-\x0D]", "[#*$%&|<>]"
#: How a sentence ends: a mark, perhaps closed by quotes or brackets. A line of prose has one somewhere, at its end or inside.
END = r"[.!?:;\x{2026}\x{3002}\x{FF01}\x{FF1F}\x{0964}\x{061F}][\"')\]\x{201D}\x{2019}\x{00BB}]*([\x20\x09-\x0D]|$)"
#: What stands between the entries of a menu.
SEPARATORS = ("|", "»", "›", "•", "·", "→", " / ", " > ", " ~ ")
#: A word decorated with symbols or repeated marks, and what such a word has to hold.
DECORATED, DECORATION = r"[^\x20\x09-\x0D]([#*$%&<>]{2}|[!?]{2})", ("#", "*", "$", "%", "&", "<", ">", "!!", "??", "!?", "?!")
SEPARATOR = "|".join(f"[{s}]" if len(s) == 1 else f" [{s[1]}] " for s in SEPARATORS)
#: Whole lines of menus, in lower case.
MENU = r"^[\x20\x09-\x0D]*(home|menu|login|log in|sign in|sign up|register|search|contact|contact us|about|about us|next|previous|back|top|back to top|read more|more|share|print|sitemap|site map|skip to content)[\x20\x09-\x0D.:!\x{00BB}]*$"
#: Phrases of notices that are no part of a text, in lower case.
BOILERPLATE = r"lorem ipsum|all rights reserved|privacy policy|cookie policy|terms of (use|service)|(uses?|accept|enable) cookies|enable javascript|javascript is (disabled|required)|(is|are) licensed under|^[\x20\x09-\x0D]*(licensed under|copyright|\(c\)|\x{00A9})|subscribe to our|click here|powered by|page [0-9]+ of [0-9]+"
#: A notice or an entry of a menu is a line of at most so many characters; a longer one with such a phrase is prose that mentions it.
NOTICE_CHARS = 200


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_rules(line: Column) -> dict[str, Column]:
    """Whether a line with words fails each rule. Patterns are counted only in lines that hold what they are made of."""
    words, short = F.regexp_count(line, F.lit(WORD)), F.char_length(line) <= NOTICE_CHARS
    holds = lambda parts: reduce(or_, (F.contains(line, F.lit(p)) for p in parts))
    often = lambda pattern: 4 * F.regexp_count(line, F.lit(pattern)) > words
    return {
        "punctuation": ~F.regexp_like(line, F.lit(END)) | (holds(DECORATION) & often(DECORATED)),
        "navigation": (holds(SEPARATORS) & often(SEPARATOR)) | (short & F.regexp_like(F.lower(line), F.lit(MENU))),
        "boilerplate": short & F.regexp_like(F.lower(line), F.lit(BOILERPLATE)),
    }


def _word_chars(text: Column) -> Column:
    return (F.char_length(text) - F.regexp_count(text, F.lit(BLANK))).cast("long")


def _windows(words: Column) -> Column:
    """A 64-bit hash of each window: of its words, then of pairs of hashes that stand 1, 2 and 4 apart. Two windows of a text of n
    words share one by chance with n^2 / 2^65."""

    def paired(hashes: Column, apart: int) -> Column:
        return let(hashes, lambda h: F.zip_with(h, F.slice(h, F.lit(apart + 1), F.size(h)), lambda a, b: F.xxhash64(a, b)))

    hashes, apart = F.transform(words, lambda w: F.xxhash64(w)), 1
    while apart < WINDOW:
        hashes, apart = paired(hashes, apart), 2 * apart
    return F.slice(hashes, F.lit(1), F.size(words) - (WINDOW - 1))


def _repeat_words(words: Column) -> Column:
    """Words in windows that occur at least twice in ``words``."""

    def covered(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))

        begin = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        step = lambda acc, i: F.struct((acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n"), i.alias("last"))
        return F.aggregate(let(in_order, starts), begin, step, lambda acc: acc["n"])

    once = lambda hashes: F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered(hashes)).otherwise(0)
    return F.when(F.size(words) < WINDOW, 0).otherwise(let(_windows(words), once)).cast("long")


def clean_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, cleaned, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed, lost_chars, base_failed, kept): a row for a
    row of ``docs``.

    ``cleaned`` is the text without its ``n_failed`` failing lines, ``lost_chars`` the characters in their words. A document is kept
    if it has at least ``MIN_WORDS`` words, at most ``MAX_REPEATED`` of 100 in repeated windows, and loses at most ``MAX_LOST`` of 100
    characters. Lines without words fail no rule. Null and empty texts have no words and are not kept; long texts are read whole;
    repeated rows give repeated rows; an empty table an empty result. Other columns are not read, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("words", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    worded = lambda x: F.regexp_like(x, F.lit(WORD))

    def fails(line: Column) -> Column:
        bad = F.lit(False)
        for rule in line_rules(line).values():
            bad |= rule
        return worded(line) & bad

    lines = F.split("text", "\n", -1)
    judged = F.transform(lines, lambda x: F.struct(x.alias("line"), fails(x).alias("bad")))
    dup = let(F.filter(lines, worded), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counted = rows.select(
        "id",
        judged.alias("judged"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOL)).cast("long").alias("n_symbols"),
        dup.cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("words")).alias("n_repeat_words"),
    )
    bad, line = (lambda x: x["bad"]), (lambda x: x["line"])
    split = counted.withColumns(
        {
            "cleaned": F.array_join(F.transform(F.filter("judged", lambda x: ~bad(x)), line), "\n"),
            "n_failed": F.size(F.filter("judged", bad)).cast("long"),
            "lost_chars": F.aggregate(F.filter("judged", bad), F.lit(0).cast("long"), lambda n, x: n + _word_chars(line(x))),
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words")),
        }
    )
    kept = ~F.col("base_failed") & (100 * F.col("lost_chars") <= MAX_LOST * F.col("word_chars"))
    return split.select("id", "cleaned", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed", "lost_chars", "base_failed", kept.alias("kept"))

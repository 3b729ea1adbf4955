"""Line-first quality rules: lines that fail a punctuation, navigation or boilerplate rule go, then documents that lose too much.

All of it is built-in expressions over one row: no shuffle, no Python. Words are runs of anything but ASCII white space.
Null texts are empty. Repeated rows and ids are rows of their own. A text without words has no lines to judge; it loses
nothing, and fails for having fewer than `LEAST_WORDS` words.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The contract's base rule.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SPACES, SYMBOLS = " \t\n\x0b\f\r", "#*$%&|<>"
#: A document goes if over this share of its word characters was in lines that failed.
MOST_LOST = 0.5
#: Marks that end a sentence, also before closing quotes and brackets.
_END_MARKS, _CLOSING = ".!?…:;。！？؟।", "\"'”’»)]"
_ENDED = rf"[{_END_MARKS}][\"'”’»)\]]*[\x20\x09-\x0D]*$"
_END_INSIDE = r"[.!?…。！？؟।][\x20\x09-\x0D]"
#: A line whose last sentence is cut off passes if it has an end of a sentence for so many words.
_SENTENCE_WORDS = 30
_WORD = r"[^\x20\x09-\x0D]"
#: Marks that stand for themselves: three of them for ten words is noise, as is a line of capitals that shouts.
_NOISE = r"[!?#*$%&|<>=_~^{}\\]"
#: Lines that are paths, menus or links: parts between bars, arrows or dots, or nothing but a call to go elsewhere.
_SEPARATORS = "|>»·•→"
_PARTS = rf"^[\x20\x09-\x0D]*(?:[^{_SEPARATORS}]{{1,40}}[{_SEPARATORS}][\x20\x09-\x0D]*)+[^{_SEPARATORS}]{{0,40}}$"
_ELSEWHERE = r"(?i)^[\x20\x09-\x0D]*(?:(?:home|menu|search|log ?in|sign (?:in|up)|subscribe|share|next|previous|back to top|skip to (?:main )?content|read more|click here|contact(?: us)?|about(?: us)?|faq|sitemap)\W*|(?:https?://|www\.)[^\x20\x09-\x0D]+[\x20\x09-\x0D]*)$"
#: Lines that every page of a site repeats, and words of which each such line has one.
_BOILERPLATE = r"all rights reserved|\b(?:licensed|released) under\b|\bis licensed under\b|^[\x20\x09-\x0D]*(?:copyright|©|\(c\))|\b(?:uses|use of|accept(?: all)?|our) cookies\b|\bprivacy policy\b|\bterms of (?:use|service)\b|\benable javascript\b|\blorem ipsum\b"
_HINTS = ("reserved", " under", "copyright", "©", "(c)", "cookies", "privacy", "terms of", "javascript", "lorem")
RULES = ("punctuation", "navigation", "boilerplate")


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def _without(text: Column, marks: str) -> Column:
    """text without any of these characters, which are ASCII."""
    return F.regexp_replace(text, "[" + "".join(f"\\x{ord(c):02X}" for c in marks) + "]+", "")


def _any(line: Column, marks: Iterable[str]) -> Column:
    return reduce(or_, [line.contains(m) for m in marks])


def failed_rule(line: Column) -> Column:
    """The first of RULES that a line fails, or null. Lines without a word fail none.

    Plain searches go before patterns: most lines have none of the words and marks that the patterns need.
    """
    low = F.lower(line)
    words = F.length(line) - F.length(_without(line, SPACES)) + 1
    last = F.substring(F.rtrim(F.rtrim(line, F.lit(SPACES)), F.lit(_CLOSING)), -1, 1)
    ends = F.size(F.split(line, _END_INSIDE)) - 1
    noise = F.length(line) - F.length(F.regexp_replace(line, _NOISE, ""))
    shouted = line.contains("!!") & (F.upper(line) == line) & (low != line)
    return (
        F.when(~line.rlike(_WORD), None)
        .when(_any(low, _HINTS) & low.rlike(_BOILERPLATE), "boilerplate")
        .when((_any(line, _SEPARATORS) & line.rlike(_PARTS)) | line.rlike(_ELSEWHERE), "navigation")
        .when(~last.isin(*_END_MARKS) & (ends * _SENTENCE_WORDS < words), "punctuation")
        .when((noise > 0) & (noise * 10 > words * 3), "punctuation")
        .when(shouted, "punctuation")
    )


def with_repeated_words(rows: DataFrame, words: str, name: str) -> DataFrame:
    """rows with `name`: how many words of the array in `words` lie in windows of WINDOW words that it has twice or more.

    Windows are compared by 64 bits of their words: two different ones of a text with a million words agree by chance
    once in forty million such texts. Texts without a repeated window, which is most, end after a hash set of longs.
    """
    paired = lambda x, y: F.zip_with(x, y, lambda a, b: F.xxhash64(a, b))
    rest = lambda c, k: F.slice(c, k, 1 << 30)
    # hashes of two words, of four, and of four and the fifth, each in a column of its own; what runs over the end is cut
    rows = rows.withColumn("_twos", paired(F.col(words), rest(words, 2)))
    rows = rows.withColumn("_fours", paired(F.col("_twos"), rest("_twos", 3)))
    fives = paired(F.slice("_fours", 1, F.size(words) - WINDOW + 1), rest(words, WINDOW))
    rows = rows.withColumn("_fives", F.when(F.size(words) >= WINDOW, fives).otherwise(F.array().cast("array<bigint>")))
    # a lambda's argument is a value: each array below is made once
    let = lambda value, of: F.get(F.transform(F.array(value), of), F.lit(0))
    again = lambda rows: F.transform(F.filter(rows, lambda r, i: (r["h"] == F.get(rows, i - 1)["h"]) | (r["h"] == F.get(rows, i + 1)["h"])), lambda r: r["i"])
    covered = lambda places: F.aggregate(F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    found = let(F.sort_array(F.transform("_fives", lambda x, i: F.struct(x.alias("h"), i.alias("i")))), lambda rows: let(F.sort_array(again(rows)), covered))
    once = F.size(F.array_distinct("_fives")) == F.size("_fives")
    return rows.withColumn(name, F.when(once, F.lit(0)).otherwise(found).cast("long")).drop("_twos", "_fours", "_fives")


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars, kept_text and failed (rule counts).

    Other columns stay, but for ones of these names. `kept_text` is the text without the lines that failed, the others
    unchanged and in order; `lost_chars` counts the word characters of lines that failed.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_text", text).withColumn("_words", words_of(F.col("_text"))).withColumn("_lines", F.split("_text", "\n"))
    rows = rows.withColumn("_judged", F.transform("_lines", lambda line: F.struct(line.alias("line"), failed_rule(line).alias("rule"))))
    rows = with_repeated_words(rows, "_words", "n_repeat_words")
    full = F.filter("_lines", lambda line: line.rlike(_WORD))
    gone = F.filter("_judged", lambda x: x["rule"].isNotNull())

    def broken(rule: str) -> Column:
        return F.size(F.filter("_judged", lambda x: x["rule"] == rule)).cast("long").alias(rule)

    return rows.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(_without(F.col("_text"), SYMBOLS))).cast("long"),
            "n_dup_lines": (F.size(full) - F.size(F.array_distinct(full))).cast("long"),
            "lost_chars": F.aggregate(F.transform(gone, lambda x: F.length(_without(x["line"], SPACES)).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b),
            "kept_text": F.array_join(F.transform(F.filter("_judged", lambda x: x["rule"].isNull()), lambda x: x["line"]), "\n"),
            "failed": F.struct(*map(broken, RULES)),
        }
    ).drop("_text", "_words", "_lines", "_judged")


def verdicts(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """`measured` rows with base_failed and kept: whether the base rule fails, and whether the document stays after its lines."""
    rows = measured(docs)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return rows.withColumn("base_failed", base).withColumn("kept", ~base & (F.col("lost_chars") <= F.lit(most_lost) * F.col("word_chars")))


def clean(docs: DataFrame, most_lost: float = MOST_LOST) -> DataFrame:
    """The documents that stay, with the columns of docs and the text that is left of them; n_chars follows where there is one."""
    rows = verdicts(docs.select("*", F.struct("*").alias("_row")), most_lost).where("kept")
    now = {"text": F.col("kept_text")} | ({"n_chars": F.length("kept_text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[now[c].alias(c) if c in now else F.col("_row")[c].alias(c) for c in docs.columns])


def line_rules(docs: DataFrame) -> DataFrame:
    """The digest columns of the contract, with what the lines lost and why."""
    rows = verdicts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars", *[F.col("failed")[r].alias(f"n_{r}") for r in RULES], F.sha2("kept_text", 256).alias("kept_sha256"))

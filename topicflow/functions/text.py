"""Text expressions: cleaning, tokens, substring counts, tag stripping."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from topicflow.functions.words import STOP_WORDS

# Characters whose NFKC form holds no ASCII character and which never merge with a
# preceding ASCII letter: European and Cyrillic letters, dashes, curly quotes, kana,
# Han and Hangul syllables. Cleaning drops them with or without normalising, so a
# text made of these and ASCII stays on the JVM. tests/test_text.py checks every one.
NFKC_NEUTRAL = (
    "\\u0000-\\u007F\\u00C0-\\u0131\\u0134-\\u013E\\u0141-\\u0148\\u014A-\\u017E\\u0400-\\u0482\\u048A-\\u052F"
    "\\u2012-\\u2015\\u2018-\\u201F\\u2020-\\u2022\\u3041-\\u3096\\u4E00-\\u9FFF\\uAC00-\\uD7A3"
)

WORD_ASCII = "[a-z0-9_]{2,}"
WORD_UNICODE = "(?U)\\w{2,}"


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.char_length(text)


def _nfkc(text: str | None) -> str | None:
    return None if text is None else unicodedata.normalize("NFKC", text)


def normalise_nfkc(text: Column) -> Column:
    """NFKC, which Spark lacks; only texts that it can change are sent to Python, a few at a time.

    Without Arrow, whose batches of 10,000 texts a worker would hold whole, twice over as Python strings.

    The function is declared non-deterministic so that Spark evaluates it exactly once:
    otherwise a later filter on the text is copied below it and calls it a second time.
    Filters that do not need the text belong before this call.
    """
    # the lookbehind runs on non-ASCII characters only, which is far cheaper than one wide class
    affected = F.when(~is_ascii(text) & text.rlike(f"[^\\x00-\\x7F](?<![{NFKC_NEUTRAL}])"), text)
    return F.coalesce(F.udf(_nfkc, StringType(), useArrow=False).asNondeterministic()(affected), text)


def strip_to_ascii(text: Column) -> Column:
    """Delete everything but printable ASCII, collapse blanks, trim.

    Tabs and newlines are control characters and vanish without leaving a blank.
    """
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20-\\x7E]+", "")
    return F.trim(F.regexp_replace(kept, " {2,}", " "))


def clean_text(text: Column) -> Column:
    return strip_to_ascii(normalise_nfkc(text))


def strip_whitespace(text: Column) -> Column:
    """Trim every kind of white space (``trim`` alone removes blanks only)."""
    return F.regexp_replace(text, "(?U)^\\s+|\\s+$", "")


def analysis_text(title: str = "title", abstract: str = "abstract", summary: str = "summary") -> Column:
    """Lower-cased title, abstract and summary, missing parts read as empty."""
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (title, abstract, summary)]
    return F.lower(F.concat(parts[0], F.lit(" "), parts[1], F.lit(" "), parts[2]))


def matched_bytes(body: Column, needle: Column) -> Column:
    """Bytes covered by non-overlapping occurrences; divide by the needle's bytes for a count.

    Summing bytes and dividing once after the aggregation keeps the sum in integers,
    and byte lengths are stored with the string, so no character is counted.
    """
    return (F.octet_length(body) - F.octet_length(F.replace(body, needle, F.lit("")))).cast("long")


def mention_count(body: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of a non-empty needle."""
    return (matched_bytes(body, needle) / F.nullif(F.octet_length(needle), F.lit(0))).cast("long")


def _sql_list(words: Sequence[str]) -> str:
    """Words as a SQL list: parsed in one go, where a literal per word would be a call each."""
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def tokens(body: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Words of two or more word characters, without stop words, in text order."""
    words = F.when(is_ascii(body), F.regexp_extract_all(body, F.lit(WORD_ASCII), 0)).otherwise(
        F.regexp_extract_all(body, F.lit(WORD_UNICODE), 0)
    )
    if not stop_words:
        return words
    return F.filter(words, lambda w: ~w.isin(list(stop_words)))


def only_words(column: str, allowed: Sequence[str]) -> Column:
    """The words of an array column with every word outside ``allowed`` turned into null."""
    if not allowed:
        return F.transform(column, lambda w: F.lit(None).cast("string"))
    return F.expr(f"transform(`{column}`, w -> CASE WHEN w IN ({_sql_list(allowed)}) THEN w END)")


def neighbours(words: Column) -> Column:
    """Every pair of neighbouring words, joined by a blank; pairs with a null word are left out.

    The words should be a plain column: the expression refers to them several times.
    """
    size = F.size(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), size - 1), F.slice(words, F.lit(2), size - 1), lambda a, b: F.concat(a, F.lit(" "), b)
    )
    return F.when(size >= 2, F.array_compact(pairs)).otherwise(F.array().cast("array<string>"))


def strip_reasoning(response: Column) -> Column:
    """Keep what follows the last closing reasoning tag and drop stray tags."""
    opening, closing = "<think>", "</think>"
    both = response.contains(opening) & response.contains(closing)
    answer = F.when(both, F.substring_index(response, closing, -1)).otherwise(response)
    for tag in (opening, closing):
        answer = F.replace(answer, F.lit(tag), F.lit(""))
    return strip_whitespace(answer)


def topic_lines(response: Column, n: int) -> Column:
    """Topics listed one per line in a model response: bullets removed, blanks dropped, first n."""
    lines = F.transform(F.split(response, "\n"), lambda s: strip_whitespace(s))
    lines = F.transform(lines, lambda s: strip_whitespace(F.regexp_replace(s, "^[-*] ", "")))
    return F.slice(F.filter(lines, lambda s: F.length(s) > 0), 1, n)

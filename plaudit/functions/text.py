"""Text cleaning and tokenising as Spark expressions.

Whitespace is one explicit set of characters, because ``\\s`` means different things in
different regex engines. A step that needs a regex first tests for a literal the match must
contain, so texts without it cost one byte scan.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plaudit.constants import HTML_ENTITIES, KEPT_PUNCTUATION, TOKEN_EDGE_PUNCTUATION

WHITESPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
WHITESPACE = "".join(
    chr(code) for code in range(0x3001) if chr(code).isspace()
)
SPACE = f"[{WHITESPACE_CLASS}]"
NON_SPACE = f"[^{WHITESPACE_CLASS}]"

_ASCII_SYMBOLS = "".join(
    chr(code)
    for code in range(128)
    if not (chr(code).isalnum() or chr(code) in KEPT_PUNCTUATION + " ")
)
_ASCII_NOISE = "".join(c for c in _ASCII_SYMBOLS if not c.isspace())


def _blank_out(text: Column, characters: str) -> Column:
    return F.translate(text, characters, " " * len(characters))


def _when_contains(
    text: Column, literals: Sequence[str], change: Callable[[Column], Column]
) -> Column:
    present = reduce(or_, (F.contains(text, F.lit(literal)) for literal in literals))
    return F.when(present, change(text)).otherwise(text)


def _unescape(text: Column) -> Column:
    for escaped in ("\\n", "\\t"):
        text = F.replace(text, F.lit(escaped), F.lit(" "))
    return text


def fix_newlines(text: Column) -> Column:
    """Escaped ``\\n`` / ``\\t`` and real newlines, returns and tabs become spaces."""
    return _blank_out(_unescape(text), "\n\r\t")


def decode_entities(text: Column) -> Column:
    """Decode the known HTML entities, in their fixed order."""
    for entity, character in HTML_ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(character))
    return text


def strip_tags(text: Column) -> Column:
    """Replace every ``<...>`` by a space.

    Nothing after the last ``>`` can be a tag; leaving that rest out of the regex keeps it
    linear on texts with many unclosed ``<``.
    """

    def change(t: Column) -> Column:
        rest = F.substring_index(t, ">", -1)
        head = F.left(t, F.length(t) - F.length(rest))
        return F.concat(F.regexp_replace(head, "<[^>]+>", " "), rest)

    return _when_contains(text, ["<"], change)


def remove_html(text: Column) -> Column:
    """Decode entities, then replace every tag by a space."""
    return strip_tags(decode_entities(text))


def _http_urls_out(text: Column) -> Column:
    return F.regexp_replace(text, f"https?://{NON_SPACE}+", " ")


def _www_urls_out(text: Column) -> Column:
    return F.regexp_replace(text, rf"www\.{NON_SPACE}+", " ")


def _emails_out(text: Column) -> Column:
    # A greedy \S+@\S+\.\S+ always covers a whole token, so this starts only at the start of a
    # token and takes its first usable @: linear in the text length.
    return F.regexp_replace(
        text,
        rf"(?<!{NON_SPACE}){NON_SPACE}[^@{WHITESPACE_CLASS}]*+@{NON_SPACE}+\.{NON_SPACE}+",
        " ",
    )


def remove_http_urls(text: Column) -> Column:
    return _when_contains(text, ["://"], _http_urls_out)


def remove_www_urls(text: Column) -> Column:
    return _when_contains(text, ["www."], _www_urls_out)


def remove_urls(text: Column) -> Column:
    """Replace ``http(s)://`` and then ``www.`` addresses by a space."""
    return remove_www_urls(remove_http_urls(text))


def remove_emails(text: Column) -> Column:
    """Replace every blank-delimited token of the shape ``x@y.z`` by a space."""
    return _when_contains(text, ["@"], _emails_out)


def decomposed(texts: pa.Array) -> pa.Array:
    """The texts decomposed, without what is outside ASCII; nulls stay.

    Text by text: as whole columns, every step would hold a copy of the batch, and a worker keeps most of
    what such batches took.
    """
    each = (text.as_py() for text in texts)
    out = (None if text is None else unicodedata.normalize("NFKD", text).encode("ascii", "ignore") for text in each)
    return pa.array(out, pa.binary()).cast(pa.string())


_decompose_to_ascii = F.arrow_udf(decomposed, T.StringType())

# Declared so that Catalyst never copies the chain into a filter pushed below it: a filter on
# cleaned text would otherwise clean every text twice.
_decompose_to_ascii = _decompose_to_ascii.asNondeterministic()


def to_ascii(text: Column) -> Column:
    """Compatibility-decompose and drop what is still outside ASCII.

    Spark has no normalisation function. Pure ASCII texts reach Python as nulls.
    """
    is_ascii = F.octet_length(text) == F.length(text)
    return F.coalesce(_decompose_to_ascii(F.when(~is_ascii, text)), text)


def blank_symbols(text: Column) -> Column:
    """Every character but ASCII letters, digits, whitespace and ``.,!?'-`` becomes a space."""
    ascii_only = F.regexp_replace(text, rf"[^\x00-\x7F{WHITESPACE_CLASS}]", " ")
    is_ascii = F.octet_length(text) == F.length(text)
    return _blank_out(F.when(is_ascii, text).otherwise(ascii_only), _ASCII_NOISE)


def squeeze_spaces(text: Column) -> Column:
    """Collapse runs of whitespace to one space and trim."""
    return F.trim(F.regexp_replace(_blank_out(text, WHITESPACE), "  +", " "))


def _squeeze_ascii(text: Column) -> Column:
    # After to_ascii, symbols and whitespace alike end up as one space.
    return F.trim(F.regexp_replace(_blank_out(text, _ASCII_SYMBOLS), "  +", " "))


# Few stages with few mentions of their input: rules that follow a column to its source expand
# every mention, so the mentions of all stages multiply in planning time.
_STAGES: tuple[Callable[[Column], Column], ...] = (
    # Real newlines count as whitespace in every later step, so only the escapes matter here.
    lambda text: _when_contains(text, ["\\", "&"], lambda t: decode_entities(_unescape(t))),
    strip_tags,
    lambda text: _when_contains(
        text, ["://", "www.", "@"], lambda t: _emails_out(_www_urls_out(_http_urls_out(t)))
    ),
    to_ascii,
    _squeeze_ascii,
)


def clean_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Run the whole cleaning chain over ``columns`` in place; null becomes ``''``.

    Each stage is its own projection over all columns: a stage reads its input more than once,
    and one projection per stage keeps Catalyst from repeating the stages below it. The Python
    step of all columns shares one Arrow pass. Filters do not move below it, so filter on other
    columns first.
    """
    if not columns:
        return df
    df = df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns})
    for stage in _STAGES:
        df = df.withColumns({c: stage(F.col(c)) for c in columns})
    return df


def is_blank(text: Column) -> Column:
    """True for null, empty or whitespace-only text."""
    return F.trim(_blank_out(F.coalesce(text, F.lit("")), WHITESPACE)) == ""


def words(text: Column) -> Column:
    """Array of the whitespace-separated words; empty for null."""
    spaced = _blank_out(F.coalesce(text, F.lit("")), WHITESPACE)
    return F.array_remove(F.split(spaced, " "), "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def cleaned_word_count(text: Column) -> Column:
    """Word count of a text out of :func:`clean_text`: one space between words, none outside."""
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def char_length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit("")))


def bare_token(word: Column) -> Column:
    """A lower-cased word without the punctuation at its ends."""
    return F.btrim(word, F.lit(TOKEN_EDGE_PUNCTUATION))


def is_countable(token: Column, stop_words: Sequence[str], min_length: int) -> Column:
    """Letters only, long enough and not a stop word."""
    long_stop_words = [w for w in stop_words if len(w) >= min_length]
    kept = F.length(token) >= min_length
    if long_stop_words:
        kept = kept & ~token.isin(long_stop_words)
    return kept & token.rlike(r"^\p{L}+$")  # the costliest test last



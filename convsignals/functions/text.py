"""Text expressions. Everything but Unicode composition is a JVM-side column expression."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes that mean the same in every engine used here.
WORD = r"\p{L}\p{N}_"

# ------------------------------------------- fixed values: masking patterns
PHONE = r"(?U)(?<![\p{L}\p{N}_])(\+?\p{Nd}[\p{Nd}\-.\s()]{5,}\p{Nd})(?![\p{L}\p{N}_])"
URL = r"(?iU)(https?://\S+|www\.\S+)"
EMAIL = r"[\p{L}\p{N}_.+-]+@[\p{L}\p{N}_-]+\.[\p{L}\p{N}_.-]+"
NUMBER = r"\p{Nd}+(?:\.\p{Nd}+)?"
NON_TEXT = r"""(?U)[^\p{L}\p{N}_\s.,!?;:'"\-()<>\[\]]"""
SPACES = r"(?U)[\s\x1c-\x1f]+"
# Every character that counts as space, for trimming ends.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
END_MARKS = ".!,;:"
# The emoji class: joiner, watch, eject, fast-forward, and all from U+24C2 on.
EMOJI_RUN = r"[\x{200D}\x{231A}\x{23CF}\x{23E9}\x{24C2}-\x{10FFFF}]+"
GENDER_SLASH_STRICT = r"[א-ת]{2,}/[א-ת]{1,2}(?=[^א-ת]|$)"
GENDER_SLASH_LOOSE = r"[א-ת]+/[א-ת]+"
HEBREW_LETTER = r"[א-ת]"


def strip(text: Column) -> Column:
    """Trim every kind of Unicode space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, SPACES, " ")


#: Bytes of text that become Python strings at once; a longer text is a piece of its own.
COMPOSE_BYTES = 1 << 20


def _composed(text: pa.Array) -> pa.Array:
    """Texts composed piece by piece; a piece of ASCII alone never becomes Python strings."""
    if not len(text):
        return text
    column = text.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    out, at = [], 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + COMPOSE_BYTES, side="right")) - 1)
        piece = column.slice(at, to - at)
        if (data[offsets[at] : offsets[to]] > 127).any():
            texts = (s if s is None or s.isascii() else unicodedata.normalize("NFC", s) for s in (x.as_py() for x in piece))
            piece = pa.array(texts, pa.large_string())
        out.append(piece)
        at = to
    return pa.concat_arrays(out).cast(text.type)


@F.arrow_udf(T.StringType())
def _compose(text: pa.Array) -> pa.Array:
    return _composed(text)


# Declared non-deterministic so that the optimizer never copies it into a filter and a projection;
# a text is then composed once, and everything after reads the result.
_compose_once = _compose.asNondeterministic()


def nfc(text: Column) -> Column:
    """Canonical composition; Spark has no built-in for it."""
    return _compose_once(text)


def normalized(text: Column) -> Column:
    """Comparison key of a message: composed, one kind of quote, single spaces, no end marks.

    Composition is the outermost step, so that later filters and hashes read its result instead of
    repeating the expressions. It commutes with the other steps but for U+037E, which composes to a
    semicolon and is therefore replaced beforehand.
    """
    key = F.translate(collapse_spaces(strip(text)), "“”‘’״׳\u037e", "\"\"''\"';")
    return nfc(strip(F.rtrim(key, F.lit(END_MARKS))))


def cleaned(
    text: Column,
    phones: bool = True,
    urls: bool = True,
    emails: bool = True,
    numbers: bool = False,
    symbols: bool = True,
    lowercase: bool = True,
) -> Column:
    """Model-input text. Masks run in this order, so digits of a URL may become a phone mask."""
    steps = [
        (phones, PHONE, " <PHONE> "),
        (urls, URL, " <URL> "),
        (emails, EMAIL, " <EMAIL> "),
        (numbers, NUMBER, " <NUM> "),
        (symbols, NON_TEXT, " "),
    ]
    out = F.coalesce(text, F.lit(""))
    for enabled, pattern, mask in steps:
        if enabled:
            out = F.regexp_replace(out, pattern, mask)
    if lowercase:
        out = F.lower(out)
    return strip(collapse_spaces(out))


def text_length(text: Column) -> Column:
    return F.length(text)


def question_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\?"))


def emoji_count(text: Column) -> Column:
    """Runs of adjacent emoji."""
    return F.regexp_count(text, F.lit(EMOJI_RUN))


def has_gender_slash(text: Column, strict: bool = True) -> Column:
    return text.rlike(GENDER_SLASH_STRICT if strict else GENDER_SLASH_LOOSE)


def has_script(text: Column, letters: str = HEBREW_LETTER) -> Column:
    return text.rlike(letters)


def word_tokens(text: Column) -> Column:
    """Lower-case word tokens of two or more characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``use``.

    An expression that a lambda refers to is otherwise evaluated again for every array element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def word_ngrams(tokens: Column, low: int = 1, high: int = 2) -> Column:
    """All n-grams of a token array for low <= n <= high, joined with one space."""

    def of_size(t: Column, n: int) -> Column:
        return F.when(
            F.size(t) >= n,
            F.transform(
                F.sequence(F.lit(1), F.size(t) - (n - 1)),
                lambda i: F.array_join(F.slice(t, i, n), " "),
            ),
        ).otherwise(F.array().cast("array<string>"))

    def all_sizes(t: Column) -> Column:
        parts = [t if n == 1 else of_size(t, n) for n in range(low, high + 1)]
        return parts[0] if len(parts) == 1 else F.concat(*parts)

    return once(tokens, all_sizes)


def char_ngrams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams inside words padded by one space; a word shorter than n counts once."""
    words = F.split(strip(F.lower(text)), SPACES)

    def of_padded(padded: Column) -> Column:
        size = F.length(padded)
        return F.flatten(
            F.transform(
                F.sequence(F.lit(low), F.least(F.lit(high), size)),
                lambda n: F.transform(
                    F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n)
                ),
            )
        )

    padded = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, of_padded))


def percent_tag(fraction: Column) -> Column:
    return F.format_string("%03dpct", F.floor(fraction * 100).cast("int"))


def id_number(conversation_id: Column, pattern: str) -> Column:
    """The number inside an id, null where the id has another form."""
    digits = F.regexp_extract(conversation_id, pattern, 1)
    return F.when(digits != "", digits.cast("long"))


def format_id(number: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.format_string("%06d", number))


def softmax(logits: Column) -> Column:
    def shifted(x: Column) -> Column:
        return once(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))

    def shares(weights: Column) -> Column:
        total = F.aggregate(weights, F.lit(0.0), lambda acc, w: acc + w)
        return once(total, lambda t: F.transform(weights, lambda w: w / t))

    return once(once(logits, shifted), shares)


def argmax(values: Column) -> Column:
    """Zero-based position of the largest value, the first one on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient that is 0 where the denominator is 0 or null."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))

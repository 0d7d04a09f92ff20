"""Caption text cleaning, transcript normalisation and tokens."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# White space as the transcript contract defines it, and the message limit of a job row.
WHITESPACE = r"[\p{Z}\t-\r\x{85}]+"
MESSAGE_LIMIT = 180
# Texts of an Arrow batch that are Python strings at a time.
TEXTS = 128


def _unsettled(form: str, below: int = 0x300) -> str:
    """Character class of everything that the normal form might change.

    Below U+0300 no character combines with its neighbour, so a text made only of such characters that are their own
    normal form is already normal. Anything else goes to the normaliser; so do the characters of short ranges, because
    every range in the class slows down the test of each character.
    """
    ranges: list[list[int]] = []
    for cp in range(below):
        if unicodedata.normalize(form, chr(cp)) == chr(cp):
            if ranges and ranges[-1][1] == cp - 1:
                ranges[-1][1] = cp
            else:
                ranges.append([cp, cp])
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges if b - a >= 40) + "]"


def _normalizer(form: str):
    @F.arrow_udf(StringType())
    def normal(values: pa.Array) -> pa.Array:
        pieces = []
        for at in range(0, len(values), TEXTS):
            piece = values.slice(at, TEXTS)
            texts = piece.to_pylist() if piece.null_count < len(piece) else None
            pieces.append(piece if texts is None else pa.array([None if v is None else unicodedata.normalize(form, v) for v in texts], piece.type))
        return pa.concat_arrays(pieces) if pieces else values


    return normal


def unicode_normal(text: Column, form: str) -> Column:
    """NFC or NFKC; texts that are already normal reach Python as nulls only."""
    # The class for Latin-1 alone is tested much faster, and settles most texts.
    todo = F.when(text.rlike(_unsettled(form, 0x100)) & text.rlike(_unsettled(form)), text)
    return F.coalesce(_normalizer(form)(todo), text)


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, WHITESPACE, " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | text.rlike(r"\A[\p{Z}\t-\r\x{85}]*\z")


def sanitize_text(text: Column, normalized: bool = False) -> Column:
    """One-line caption text. ``normalized=True`` states that the input is NFC already and stays in the JVM."""
    source = F.coalesce(text, F.lit(""))
    normal = source if normalized else unicode_normal(source, "NFC")
    return collapse_whitespace(F.replace(normal, F.lit("-->"), F.lit("→")))


def _bare(text: Column, normalized: bool) -> Column:
    """NFKC, lower case, without punctuation.

    Capital sigma is mapped first because lower-casing here is one character at a time, whatever its place.
    """
    normal = text if normalized else unicode_normal(text, "NFKC")
    lowered = F.lower(F.replace(normal, F.lit("Σ"), F.lit("σ")))
    return F.regexp_replace(lowered, r"\p{P}", "")


def normalize_text(text: Column, normalized: bool = False) -> Column:
    """Comparison form of a transcript: NFKC, lower case, no punctuation, single spaces."""
    return collapse_whitespace(_bare(text, normalized))


def tokenize(text: Column, normalized: bool = False) -> Column:
    """Words of the comparison form; a blank text has none."""
    return F.array_remove(F.split(_bare(F.coalesce(text, F.lit("")), normalized), WHITESPACE), "")


def compact_message(text: Column) -> Column:
    flat = collapse_whitespace(text)
    return F.when(F.length(flat) > MESSAGE_LIMIT, F.concat(F.substring(flat, 1, MESSAGE_LIMIT - 1), F.lit("…"))).otherwise(flat)


def has_vtt_header(text: Column, strict: bool = True) -> Column:
    """Optional byte order mark, then WEBVTT; the strict form also needs white space or the end after it."""
    return text.rlike(r"\A\x{FEFF}?WEBVTT" + (r"([\p{Z}\t-\r\x{85}]|\z)" if strict else ""))


def is_header_only(text: Column) -> Column:
    return text.rlike(r"\A\x{FEFF}?WEBVTT[\p{Z}\t-\r\x{85}]*\z")


def is_sha256(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\A[0-9A-Fa-f]{64}\z"), F.lit(False))


def strict_utf8(content: Column) -> Column:
    """Struct of the decoded text, or an error for bytes that are not UTF-8."""
    text = content.cast("string")
    ok = F.is_valid_utf8(text)
    return F.struct(
        F.when(ok, text).alias("text"),
        F.when(~ok, F.lit("content is not valid UTF-8")).alias("error"),
    )


def sha256_hex(content: Column) -> Column:
    return F.upper(F.sha2(content, 256))


def data_sha256_hex(content: Column, offset: Column, length: Column) -> Column:
    """Hash of a byte range only, as for the PCM data of a WAVE file."""
    return sha256_hex(F.substring(content, offset.cast("int") + 1, length.cast("int")))

"""Byte-level BPE over Arrow batches: token ids with character offsets, and back to bytes and text."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StringType, StructField, StructType
from tokenizers import Regex, Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

from voxtide.llm.batches import by_bytes, list_column

# Encoded words that a worker remembers (some 200 bytes each), the longest of them in characters, and the bytes of
# texts or ids worked on at once.
REMEMBERED, LONGEST, BATCH_BYTES = 400_000, 48, 1 << 20


def byte_characters() -> list[str]:
    """The character that stands for each byte in vocabulary entries: itself where it is printable Latin-1 and
    no blank, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[bytes, ...]:
    """Bytes of each token id: lines of base64 and rank."""
    with open(path, "rb") as file:
        ranked = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in file if line.strip())}
    return tuple(ranked.get(i, b"") for i in range(max(ranked) + 1))


@lru_cache(maxsize=4)
def tokenizers_of(path: str, pattern: str) -> tuple[Tokenizer, Tokenizer]:
    """The ranks as two tokenizers: of texts, cut by ``pattern``, and of lines that are one piece each.

    A merge is any pair of tokens that together are a token; the lowest rank goes first.
    """
    table = byte_characters()
    names = {"".join(table[b] for b in token): rank for rank, token in enumerate(token_bytes(path)) if token}
    merges = [
        (name[:i], name[i:]) for name in names for i in range(1, len(name)) if name[:i] in names and name[i:] in names
    ]
    made, model = [], BPE(vocab=names, merges=merges)
    for cut in (Regex(pattern), "\n"):
        tokenizer = Tokenizer(model)
        tokenizer.pre_tokenizer = Sequence([Split(cut, "isolated"), ByteLevel(add_prefix_space=False, use_regex=False)])
        made.append(tokenizer)
    return made[0], made[1]


class Encoder:
    """Encodes texts; words between single blanks are encoded once and remembered, up to a fixed number of them."""

    def __init__(self, path: str, pattern: str):
        self.texts, self.pieces = tokenizers_of(path, pattern)
        # Ids as bytes of little-endian 32-bit numbers: of a word at a line's start, and of one after a blank.
        self.bare: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.line_feed = self._ids(self.texts, "\n").tobytes()
        # What follows letters as a piece of its own.
        self.stops = {stop: self._ids(self.texts, stop).tobytes() for stop in ("", ".", ",")}

    @staticmethod
    def _ids(tokenizer: Tokenizer, text: str) -> np.ndarray:
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<i4")

    def _learn(self, known: dict[str, bytes], words: set[str], before: str) -> None:
        new = {word for word in words if word not in known}
        if len(self.bare) + len(self.spaced) + len(new) > REMEMBERED:
            known.clear()
            new = words
        plain, other = set(), []
        for word in new:
            core = word[:-1] if word[-1:] in (".", ",") else word
            # Plain Latin letters are one piece in any version of Unicode.
            if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
                plain.add(core)
            else:
                other.append(word)
        fresh = [core for core in plain if core not in known]
        if fresh:
            ids = self._ids(self.pieces, "\n".join([before + core for core in fresh]))
            data, step = ids.tobytes(), len(self.line_feed)
            edges = np.flatnonzero(ids == np.frombuffer(self.line_feed, "<i4")[0]) * 4
            at = 0
            for core, edge in zip(fresh, chain(edges.tolist(), (len(data),))):
                known[core] = data[at:edge]
                at = edge + step
        for word in other:
            known[word] = self._ids(self.texts, before + word).tobytes()
        for word in new:
            if word not in known:
                known[word] = known[word[:-1]] + self.stops[word[-1]]

    def encode(self, text: str) -> np.ndarray:
        """Ids as a text of its own would have them."""
        words = text.split()
        # Every white space is a single blank or line feed between words, and no word is too long to remember?
        breaks = text.count("\n")
        single = len(words) - 1 == text.count(" ") + breaks and sum(map(len, words)) + len(words) - 1 == len(text)
        if not words or not single or len(max(words, key=len)) > LONGEST:
            return self._ids(self.texts, text) if text else np.empty(0, "<i4")
        lines = [line.split(" ") for line in text.split("\n")] if breaks else [words]
        self._learn(self.bare, {line[0] for line in lines}, "")
        self._learn(self.spaced, {w for line in lines for w in line[1:]}, " ")
        spaced = self.spaced.__getitem__
        parts = [b"".join(chain((self.bare[line[0]],), map(spaced, line[1:]))) for line in lines]
        return np.frombuffer(self.line_feed.join(parts), dtype="<i4")


def character_starts(lengths: np.ndarray, text: bytes) -> np.ndarray:
    """Index of the character in which each token begins: one that begins inside a character gets that character."""
    leads = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
    character = np.cumsum(leads, dtype=np.int32) - 1
    return character[np.cumsum(lengths) - lengths] if len(lengths) else np.empty(0, np.int32)


def encode_transcripts(transcripts: DataFrame, path: str, pattern: str) -> DataFrame:
    """All columns of the transcripts, and ``token_ids``, ``char_starts`` (array<int>) of the whole ``text``.

    ``path`` names a file of base64 tokens and ranks that every executor has; ``pattern`` cuts a text into pieces
    that are encoded each by itself. ``char_starts`` has the index of the character in which each token begins; a
    character split over tokens is the same for all of them. Nothing in a text is a special token.

    Null and empty texts have no tokens. Columns named like the two new ones are replaced, others pass through.
    Repeated rows are encoded one by one; an empty table gives no rows.
    """
    rows = transcripts.drop("token_ids", "char_starts")
    names = rows.columns
    at = names.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path, pattern)
        lengths = np.array([len(token) for token in token_bytes(path)], dtype=np.int64)
        for batch in by_bytes(batches, at, BATCH_BYTES):
            texts = [t or "" for t in batch.column(at).to_pylist()]
            ids = [encoder.encode(t) for t in texts]
            starts = [character_starts(lengths[i], t.encode()) for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, list_column(ids), list_column(starts)], [*names, "token_ids", "char_starts"])

    ints = ArrayType(IntegerType(), False)
    return rows.mapInArrow(encode, StructType([*rows.schema.fields, StructField("token_ids", ints), StructField("char_starts", ints)]))


def decode_tokens(tokens: DataFrame, path: str) -> DataFrame:
    """All columns, and what ``token_ids`` stand for: ``content`` (binary) and ``decoded`` (string).

    The bytes are exact for any ids. In ``decoded``, bytes that are no whole character, as at the edges of a
    slice of ids that splits one, become U+FFFD. Null ids stay null; an id that the vocabulary lacks is an error. Columns
    named ``content`` or ``decoded`` are replaced; an empty table gives no rows.
    """
    rows = tokens.drop("content", "decoded")
    names = rows.columns
    at = names.index("token_ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in by_bytes(batches, at, BATCH_BYTES):
            column = batch.column(at)
            ids = [None if x is None else x.tolist() for x in (v.values.to_numpy() if v.is_valid else None for v in column)]
            if any(min(x) < 0 for x in ids if x):
                raise ValueError("token ids start at 0")
            content = [None if x is None else b"".join(map(table.__getitem__, x)) for x in ids]
            decoded = [None if x is None else x.decode("utf-8", "replace") for x in content]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(content, pa.binary()), pa.array(decoded, pa.string())], [*names, "content", "decoded"])

    return rows.mapInArrow(decode, StructType([*rows.schema.fields, StructField("content", BinaryType()), StructField("decoded", StringType())]))

"""Transcripts under two tokenizers: which tokens cover the same bytes, and how often the corpus links two ids."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from voxtide.llm.batches import by_bytes, list_column
from voxtide.llm.byte_bpe import byte_characters
from voxtide.session import cut_lineage, shared_dir

# Words that a worker remembers for each tokenizer, and the longest of them in characters.
REMEMBERED, LONGEST = 200_000, 48
# Text bytes aligned together, and pairs of ids expanded at once.
BATCH_BYTES, PAIRS = 1 << 20, 1 << 21
# Most frequent pairs that are sent to every task; the others are joined by a shuffle.
HEAD = 200_000
SPACE = "▁"
STOPS = ".,"


class Side:
    """One tokenizer: ids of a blank and a text, and the bytes that each id stands for."""

    contents: list[bytes]
    # Whether no token reaches over the start of a word behind a blank or a line feed.
    apart: bool

    def __init__(self) -> None:
        self.sizes = np.array([len(c) for c in self.contents], dtype=np.int64)
        self.line_feed = self.ids("\n")[-1:]

    def ids(self, text: str) -> np.ndarray:
        raise NotImplementedError

    def word_ids(self, words: list[str], spaced: bool) -> list[list[int]]:
        """Ids of words behind a blank, or behind a line feed."""
        raise NotImplementedError

    def spells(self, ids: np.ndarray, text: str) -> bool:
        return b"".join(map(self.contents.__getitem__, ids.tolist())) == b" " + text.encode()


class ByteSide(Side):
    """A byte-level BPE file; nothing in a text is a special token."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        table = {ord(c): byte for byte, c in enumerate(byte_characters())}
        names = {token: name for name, token in self.tokenizer.get_vocab(with_added_tokens=False).items()}
        self.contents = [names.get(i, "").translate(table).encode("latin-1") for i in range(max(names) + 1)]
        # Pieces begin at a blank before a word and at a word after a line feed: the file's own splitter says so.
        splitter = self.tokenizer.pre_tokenizer
        self.apart = self.tokenizer.normalizer is None and [p for p, _ in splitter.pre_tokenize_str(" a b\nc\n d")] == [
            "Ġa", "Ġb", "Ċ", "c", "Ċ", "Ġd"
        ]
        self.characters = dict(enumerate(byte_characters()))
        self.stops = {stop: self.tokenizer.encode(stop, add_special_tokens=False).ids for stop in STOPS}
        super().__init__()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids, dtype="<i4")

    def word_ids(self, words: list[str], spaced: bool) -> list[list[int]]:
        merge, before = self.tokenizer.model.tokenize, " " if spaced else ""
        out, others = [], []
        for k, word in enumerate(words):
            core = word[:-1] if word[-1] in STOPS else word
            # Latin letters are one piece in any version of Unicode, and a stop behind them another.
            if core.isalpha() and (core.isascii() or max(core) < "\u0250"):
                piece = (before + core).encode().decode("latin-1").translate(self.characters)
                ids = [token.id for token in merge(piece)]
                out.append(ids if len(core) == len(word) else ids + self.stops[word[-1]])
            else:
                out.append([])
                others.append(k)
        encoded = self.tokenizer.encode_batch_fast([before + words[k] for k in others], add_special_tokens=False)
        for k, found in zip(others, encoded):
            out[k] = found.ids
        return out


class PieceSide(Side):
    """A piece model with byte fallback, which puts a blank before a text by itself."""

    def __init__(self, path: str):
        self.model = SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.contents = [
            bytes([int(piece[1:-1], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode() for i, piece in enumerate(pieces)
        ]
        # Blanks stand at the start of a piece or fill it, and a line feed is a byte.
        self.apart = not any("\n" in p or (SPACE in p[1:] and p.strip(SPACE)) for p in pieces)
        super().__init__()

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.model.encode([text], num_threads=1)[0], dtype="<i4")

    def word_ids(self, words: list[str], spaced: bool) -> list[list[int]]:
        if spaced:
            return self.model.encode(words, num_threads=1)
        # The blank that the model puts first, and the line feed, are two tokens.
        return [ids[2:] for ids in self.model.encode(["\n" + word for word in words], num_threads=1)]


class Encoder:
    """Both sides of texts. Words between single blanks and line feeds are encoded once and remembered, up to a fixed
    number; other texts are encoded as a whole. A text that the tokens of a side do not spell has none."""

    def __init__(self, a: Side, b: Side):
        self.sides, self.apart = (a, b), a.apart and b.apart
        # Of each side: ids of words behind a blank, and of words behind a line feed.
        self.known: tuple[tuple[dict[str, bytes], ...], ...] = (({}, {}), ({}, {}))
        self.misspelt: set[str] = set()

    def _learn(self, kind: int, words: set[str]) -> None:
        known = self.known[0][kind]
        new = [word for word in words if word not in known]
        if len(known) + len(new) > REMEMBERED:
            for side in self.known:
                side[kind].clear()
            new = list(words)
        if not new:
            return
        whole = b"".join([(" " + word if kind == 0 else word).encode() for word in new])
        for side, store in zip(self.sides, self.known):
            ids = side.word_ids(new, kind == 0)
            data = np.fromiter(chain.from_iterable(ids), dtype="<i4").tobytes()
            at = 0
            for word, found in zip(new, ids):
                upto = at + 4 * len(found)
                store[kind][word] = data[at:upto]
                at = upto
            if b"".join(map(side.contents.__getitem__, chain.from_iterable(ids))) != whole:
                self.misspelt.update(w for w in new if not side.spells(side.ids(w), w))

    def _cut(self, text: str) -> list[list[str]] | None:
        """Lines of words, if the text is nothing but short words between single blanks and line feeds."""
        words = text.split()
        breaks = text.count("\n")
        single = len(words) - 1 == text.count(" ") + breaks and sum(map(len, words)) + len(words) - 1 == len(text)
        if not (self.apart and words and single) or SPACE in text or len(max(words, key=len)) > LONGEST:
            return None
        return [line.split(" ") for line in text.split("\n")] if breaks else [words]

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        cuts = [self._cut(text) for text in texts]
        known = [cut for cut in cuts if cut is not None]
        self._learn(0, set().union(*(line[1:] for cut in known for line in cut[1:]), *(cut[0] for cut in known)))
        self._learn(1, {line[0] for cut in known for line in cut[1:]})
        out: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        none = np.empty(0, "<i4")
        for text, cut in zip(texts, cuts):
            if cut is None:
                ids = [side.ids(text) for side in self.sides] if text else [none, none]
                good = bool(text) and all(side.spells(i, text) for side, i in zip(self.sides, ids))
            else:
                good = not self.misspelt or not any(word in self.misspelt for line in cut for word in line)
                ids = []
                for side, (spaced, bare) in zip(self.sides, self.known):
                    parts, stop = list(map(spaced.__getitem__, cut[0])), side.line_feed.tobytes()
                    for line in cut[1:]:
                        parts += (stop, bare[line[0]], *map(spaced.__getitem__, line[1:]))
                    ids.append(np.frombuffer(b"".join(parts), dtype="<i4"))
            for found, i in zip(out, ids):
                found.append(i if good else none)
        return out


@lru_cache(maxsize=2)
def _encoder(byte_path: str, piece_path: str) -> Encoder:
    return Encoder(ByteSide(byte_path), PieceSide(piece_path))


def _tokens(ids: list[np.ndarray], side: Side) -> pd.DataFrame:
    """Tokens of a batch in order: their transcript, id, first and behind-last byte, counted through the batch."""
    ids_in_order = np.concatenate(ids).astype(np.int64) if ids else np.empty(0, np.int64)
    sizes = side.sizes[ids_in_order]
    end = np.cumsum(sizes)
    return pd.DataFrame({"row": np.repeat(np.arange(len(ids)), [len(i) for i in ids]), "id": ids_in_order, "start": end - sizes, "end": end})


def overlapping(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    """Pairs ``a, b`` of positions of tokens that share a byte.

    The later of two overlapping tokens starts inside the other, so every start finds the token that covers it on
    the other side, in both directions, and the union of both is all.
    """
    left = pd.DataFrame({"start": a["start"], "row": a["row"], "a": np.arange(len(a))})
    right = pd.DataFrame({"start": b["start"], "row": b["row"], "b": np.arange(len(b))})
    forth = pd.merge_asof(left, right, on="start", by="row")[["a", "b"]]
    back = pd.merge_asof(right, left.rename(columns={"start": "from"}), left_on="start", right_on="from", by="row")
    # Tokens that start together were found in both directions.
    return pd.concat([forth, back.loc[back["from"] < back["start"], ["a", "b"]]], ignore_index=True)


def grouped(a: pd.DataFrame, b: pd.DataFrame) -> int:
    """Adds the ``group`` of each token, numbered through the batch: groups end where tokens of both sides end."""
    cuts = np.intersect1d(a["end"].to_numpy(), b["end"].to_numpy(), assume_unique=True)
    a["group"], b["group"] = (np.searchsorted(cuts, side["end"].to_numpy()) for side in (a, b))
    return len(cuts)


def _counted(key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, which = np.unique(key, return_inverse=True)
    return keys, np.bincount(which, weights=times, minlength=len(keys)).astype(np.int64)


def linked(
    a: pd.DataFrame, b: pd.DataFrame, pairs: pd.DataFrame, groups: int, widths: tuple[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, id of a, id of b) whose tokens share a group, packed into a number, and how often they do.
    ``pairs`` are the overlapping tokens.

    Where a group has one token on a side, its links are the overlaps. In the others every token meets every token of
    the other side, which is expanded by distinct ids, a bounded number of pairs at a time.
    """
    rows_a, rows_b = a["row"].to_numpy(), b["row"].to_numpy()
    id_a, id_b = a["id"].to_numpy(), b["id"].to_numpy()
    group_a, group_b = a["group"].to_numpy(), b["group"].to_numpy()
    wide = (np.bincount(group_a, minlength=groups) > 1) & (np.bincount(group_b, minlength=groups) > 1)
    first, second = pairs["a"].to_numpy(), pairs["b"].to_numpy()
    narrow = ~wide[group_a[first]]
    first, second = first[narrow], second[narrow]
    packed = (rows_a[first] * widths[0] + id_a[first]) * widths[1] + id_b[second]
    keys, times = np.unique(packed, return_counts=True)
    in_a, in_b = wide[group_a], wide[group_b]
    if not in_a.any():
        return keys, times
    left, left_times = np.unique(group_a[in_a] * widths[0] + id_a[in_a], return_counts=True)
    right, right_times = np.unique(group_b[in_b] * widths[1] + id_b[in_b], return_counts=True)
    row_of = np.zeros(groups, dtype=np.int64)
    row_of[group_a] = rows_a
    right_group = right // widths[1]
    begin, end = (np.searchsorted(right_group, left // widths[0], side=s) for s in ("left", "right"))
    ends = np.cumsum(end - begin)
    at = 0
    while at < len(left):
        before = int(ends[at - 1]) if at else 0
        upto = max(at + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        count = (end - begin)[at:upto]
        i = np.repeat(np.arange(at, upto), count)
        j = np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count) + begin[i]
        more = (row_of[left[i] // widths[0]] * widths[0] + left[i] % widths[0]) * widths[1] + right[j] % widths[1]
        keys, times = _counted(np.concatenate([keys, more]), np.concatenate([times, left_times[i] * right_times[j]]))
        at = upto
    return keys, times


@lru_cache(maxsize=8)
def _written(size: int, mark: str) -> np.ndarray:
    return np.array([f"{i}{mark}" for i in range(size)], dtype=object)


def written_groups(a: pd.DataFrame, b: pd.DataFrame, rows: int, widths: tuple[int, int]) -> list[str]:
    """Each row's groups as text: ids of a, ``|``, ids of b, with ``,`` between ids and ``;`` between groups."""
    group_a, group_b = a["group"].to_numpy(), b["group"].to_numpy()
    last_a, last_b = (np.append(g[1:] != g[:-1], True) if len(g) else np.empty(0, bool) for g in (group_a, group_b))
    out = np.empty(len(a) + len(b), dtype=object)
    for tokens, others, side, last, mark, width in (
        (group_a, group_b, "left", last_a, "|", widths[0]),
        (group_b, group_a, "right", last_b, ";", widths[1]),
    ):
        ids = (a if mark == "|" else b)["id"].to_numpy()
        place = np.arange(len(tokens)) + np.searchsorted(others, tokens, side=side)
        out[place] = np.where(last, _written(width, mark)[ids], _written(width, ",")[ids])
    edges = sum(np.searchsorted(side["row"].to_numpy(), np.arange(rows + 1)) for side in (a, b)).tolist()
    return ["".join(out[edges[k] : edges[k + 1]].tolist())[:-1] for k in range(rows)]


ADDED = StructType(
    [
        *(StructField(name, LongType(), False) for name in ("a_tokens", "b_tokens", "groups", "overlaps", "links")),
        StructField("grouping", StringType(), False),
        *(StructField(name, ArrayType(IntegerType(), False), False) for name in ("link_a", "link_b")),
        StructField("link_times", ArrayType(LongType(), False), False),
    ]
)


def _aligned(texts: list[str], encoder: Encoder) -> list[pa.Array]:
    """The added columns of a batch of texts."""
    ids_a, ids_b = encoder.encode(texts)
    a_side, b_side = encoder.sides
    rows, widths = len(texts), (len(a_side.contents), len(b_side.contents))
    a, b = _tokens(ids_a, a_side), _tokens(ids_b, b_side)
    groups = grouped(a, b)
    pairs = overlapping(a, b)
    keys, times = linked(a, b, pairs, groups, widths)
    row_of_key = keys // (widths[0] * widths[1])

    def per_row(row: np.ndarray, weights: np.ndarray | None = None) -> pa.Array:
        return pa.array(np.bincount(row, weights=weights, minlength=rows).astype(np.int64))

    group_rows = np.zeros(groups, dtype=np.int64)
    group_rows[a["group"].to_numpy()] = a["row"].to_numpy()
    edges = np.searchsorted(row_of_key, np.arange(rows + 1))
    lists = [(keys // widths[1] % widths[0], "int32"), (keys % widths[1], "int32"), (times, "int64")]
    return [
        per_row(a["row"].to_numpy()),
        per_row(b["row"].to_numpy()),
        per_row(group_rows),
        per_row(a["row"].to_numpy()[pairs["a"].to_numpy()]),
        per_row(row_of_key, times),
        pa.array(written_groups(a, b, rows, widths), pa.string()),
        *(list_column([values[edges[k] : edges[k + 1]] for k in range(rows)], dtype) for values, dtype in lists),
    ]


def align_transcripts(transcripts: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """All columns of the transcripts, and how the tokens of ``text`` under a byte-level BPE file (a) and under a piece
    model with byte fallback (b) cover each other, both of a blank and the whole text.

    ``a_tokens``, ``b_tokens``; ``groups``, the number of stretches between bytes where tokens of both sides end;
    ``overlaps``, pairs of tokens that share a byte; ``links``, pairs that share a group; ``grouping``, the ids of each
    group as ``a1,a2|b1;a3|b2,b3``; ``link_a, link_b, link_times``, the distinct linked ids in order and how many pairs
    of tokens they are. Both files must be at these paths on every executor. Nothing in a text is a special token.

    Null and empty texts, and texts that the tokens of a side do not spell (such as those with U+2581, which the
    pieces read as a blank), have no tokens: zeros, an empty ``grouping`` and empty lists. Columns named like the new ones are
    replaced, others pass through. Repeated rows are aligned one by one; an empty table gives no rows.
    """
    rows = transcripts.drop(*ADDED.names)
    names = rows.columns
    at = names.index("text")

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(byte_path, piece_path)
        for batch in by_bytes(batches, at, BATCH_BYTES):
            texts = [text or "" for text in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *_aligned(texts, encoder)], [*names, *ADDED.names])

    return rows.mapInArrow(align, StructType([*rows.schema.fields, *ADDED.fields]))


def _most_frequent(counts: DataFrame, most: int) -> int:
    """The least power of two such that at most ``most`` pairs are held that often; 1 if all of them fit."""
    level = F.length(F.bin("held")) - 1
    sizes = {r["level"]: r["count"] for r in counts.groupBy(level.alias("level")).count().collect()}
    total = 0
    for k in sorted(sizes, reverse=True):
        total += sizes[k]
        if total > most:
            return 1 << (k + 1)
    return 1


def score_links(aligned: DataFrame, head: int = HEAD) -> DataFrame:
    """All columns of aligned transcripts but the three lists, and what the corpus says of their links:
    ``best_links`` (links whose pair of ids is in as many transcripts as any pair with the same id of a, ties
    included) and ``count_sum`` (that number of transcripts, summed over the links).

    ``aligned`` has ``link_a, link_b, link_times`` as :func:`align_transcripts` gives them, nulls for none. It is
    written once in the shared folder, as three jobs read it. The ``head`` most frequent pairs at most go to every task; pairs
    below them are in few transcripts each, and are joined by a shuffle without hot keys. Columns named
    like the two new ones are replaced; repeated rows count once each; an empty table gives no rows.
    """
    spark = aligned.sparkSession
    folder = os.path.join(shared_dir(spark), f"aligned-{uuid.uuid4().hex}")
    # Numbered as they are written, so that every job sees the same numbers.
    aligned.drop("best_links", "count_sum").withColumn("_row", F.monotonically_increasing_id()).write.parquet(folder)
    rows = spark.read.parquet(folder)
    zipped = F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_times").alias("times"))
    pairs = rows.select("_row", F.inline(zipped))
    counts = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("held"))
    # An id of a has at most as many partners as the other vocabulary has ids.
    best = F.max("held").over(Window.partitionBy("a"))
    counts = cut_lineage(counts.withColumn("best", F.col("held") == best))
    least = _most_frequent(counts, head)
    found = pairs.join(F.broadcast(counts.filter(F.col("held") >= least)), ["a", "b"], "inner" if least == 1 else "left")
    sums = [F.sum(F.when(F.col("best"), F.col("times"))).alias("_best"), F.sum(F.col("times") * F.col("held")).alias("_sum")]
    scored = found.filter("held IS NOT NULL").groupBy("_row").agg(*sums)
    if least > 1:
        rare = found.filter("held IS NULL").select("_row", "a", "b", "times").hint("shuffle_merge")
        rest = rare.join(counts.filter(F.col("held") < least), ["a", "b"]).groupBy("_row").agg(*sums)
        scored = scored.union(rest).groupBy("_row").agg(F.sum("_best").alias("_best"), F.sum("_sum").alias("_sum"))
    kept = rows.drop("link_a", "link_b", "link_times").join(scored, "_row", "left")
    return kept.select(
        *(c for c in aligned.columns if c not in ("link_a", "link_b", "link_times", "best_links", "count_sum")),
        F.coalesce("_best", F.lit(0)).cast("bigint").alias("best_links"),
        F.coalesce("_sum", F.lit(0)).cast("bigint").alias("count_sum"),
    )

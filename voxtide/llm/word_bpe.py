"""Word BPE by speculation: greedy longest matches, every neighbouring pair checked, exact merging of what fails."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType
from tokenizers import Tokenizer

from voxtide.llm.batches import by_bytes, list_column
from voxtide.llm.byte_bpe import byte_characters

# Chunks of text that a worker remembers, the longest of them in characters, and text bytes worked on at once.
REMEMBERED, LONGEST, BATCH_BYTES = 200_000, 48, 1 << 20
CHUNK = re.compile(r"[^\x20\x09-\x0D]+")
STOPS = ".,!?;:"
# No merge has this rank.
NEVER = np.int64(1) << 60


class Merges:
    """The merge rules of a BPE model, and which neighbours in a sequence of its tokens stay apart.

    Merging goes by rank, the leftmost pair first, and no rule uses what a later one makes. So a token exists from
    the rank of its own rule to that of the rule that takes it up, and along a border between two tokens only
    the right ends of the first and the left ends of the second ever meet. The two are final exactly if no rule
    joins two ends that meet while both exist; and a word's tokens are its encoding if all neighbours are.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]]):
        size = max(vocabulary.values(), default=-1) + 1
        self.size = size
        self.rank = np.full(size, -1, dtype=np.int64)
        self.left = np.full(size, -1, dtype=np.int64)
        self.right = np.full(size, -1, dtype=np.int64)
        rules = [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in merges]
        table = np.array(rules, dtype=np.int64).reshape(-1, 3)
        keys = table[:, 0] * size + table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        first = np.unique(table[:, 2], return_index=True)
        self.left[first[0]], self.right[first[0]] = table[first[1], 0], table[first[1], 1]
        self.rank[first[0]] = first[1]
        ordered = np.maximum(self.rank[table[:, 0]], self.rank[table[:, 1]]) < np.arange(len(table))
        if len(first[0]) < len(table) or not ordered.all():
            raise ValueError("a token has two merge rules, or a rule uses a later one's token")

    def rank_of(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Rank of the rule that joins each pair, ``NEVER`` where there is none."""
        if not len(self.keys):
            return np.full(len(first), NEVER)
        wanted = first * self.size + second
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NEVER)

    def apart(self, first: np.ndarray, second: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether the tokens of each pair stay apart; of rules below rank ``before`` only, where given.

        Walks back in time: of the two ends that meet, the one made last is undone. At equal ranks the first token's
        end was made first, being further left, so the second's is undone before it.
        """
        a, b = first.astype(np.int64), second.astype(np.int64)
        # Twice the rank up to which a rule counts, plus one where that rank itself does.
        limit = np.full(len(a), 2 * NEVER) if before is None else 2 * before.astype(np.int64)
        apart = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            joined = 2 * self.rank_of(a, b) < limit
            apart[live[joined]] = False
            rank_a, rank_b = self.rank[a], self.rank[b]
            on = ~joined & (np.maximum(rank_a, rank_b) >= 0)
            live, a, b, rank_a, rank_b = live[on], a[on], b[on], rank_a[on], rank_b[on]
            of_b = rank_b >= rank_a
            limit = np.where(of_b, 2 * rank_b + 1, 2 * rank_a)
            a, b = np.where(of_b, a, self.right[a]), np.where(of_b, self.left[b], b)
        return apart

    def sound(self, base: np.ndarray) -> np.ndarray:
        """Whether each token is what merging its own characters gives; ``base`` marks single characters."""
        good = base.copy()
        made = np.flatnonzero(self.rank >= 0)
        made = made[np.argsort(self.rank[made], kind="stable")]
        reached = self.apart(self.left[made], self.right[made], self.rank[made])
        for token, fine in zip(made.tolist(), reached.tolist()):
            good[token] = fine and good[self.left[token]] and good[self.right[token]]
        return good


class Trie:
    """Tokens by their bytes, for longest matches in many words at once."""

    def __init__(self, inner: dict[bytes, int], ends: dict[bytes, int]):
        steps: dict[int, int] = {}
        accept: list[dict[int, int]] = [{}, {}]
        for which, tokens in enumerate((inner, ends)):
            for name, token in tokens.items():
                state = 0
                for byte in name:
                    state = steps.setdefault(state << 8 | byte, len(steps) + 1)
                accept[which][state] = token
        self.keys = np.array(sorted(steps), dtype=np.int64)
        self.states = np.array([steps[k] for k in self.keys.tolist()], dtype=np.int64)
        self.inner, self.ends = (np.full(len(steps) + 1, -1, dtype=np.int64) for _ in range(2))
        for which, table in enumerate((self.inner, self.ends)):
            table[list(accept[which])] = list(accept[which].values())

    def cover(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest tokens from left to right, the last one a word's end: owners and tokens in order, and which words
        have no such cover."""
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        end = np.cumsum(sizes)
        live = np.flatnonzero(sizes > 0)
        failed = sizes == 0
        at, stop = end[live] - sizes[live], end[live]
        state, best, token = np.zeros(len(live), np.int64), np.full(len(live), -1), np.full(len(live), -1)
        owners, tokens = [], []
        while len(live):
            # One character further where the trie goes on, else one token out and on behind it.
            key = state << 8 | text[np.minimum(at, len(text) - 1)]
            place = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = (at < stop) & (self.keys[place] == key)
            state, at = np.where(on, self.states[place], state), at + on
            found = np.where(at < stop, self.inner[state], self.ends[state])
            found[~on] = -1
            best, token = np.where(found >= 0, at, best), np.where(found >= 0, found, token)
            out = np.flatnonzero(~on)
            hit = out[best[out] >= 0]
            owners.append(live[hit])
            tokens.append(token[hit])
            failed[live[out[best[out] < 0]]] = True
            at[out], state[out], token[out] = best[out], 0, -1
            keep = np.ones(len(live), dtype=bool)
            keep[out] = (best[out] >= 0) & (best[out] < stop[out])
            best[out] = -1
            if not keep.all():
                live, at, stop, state, best, token = (x[keep] for x in (live, at, stop, state, best, token))
        owner, given = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (owners, tokens))
        order = np.argsort(owner, kind="stable")
        return owner[order], given[order], failed


class WordEncoder:
    """Encodes texts with a tokenizer file whose pieces are words that end in a suffix."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            stated = json.load(file)
        model, added = stated["model"], stated["added_tokens"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("ignore_merges"):
            raise ValueError("no plain BPE model")
        if any(token["normalized"] or token["lstrip"] or token["rstrip"] or token["single_word"] for token in added):
            raise ValueError("added tokens are looked for as they stand")
        vocabulary, suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(pair.split(" ", 1)) if isinstance(pair, str) else tuple(pair) for pair in model["merges"]]
        self.merges = Merges(vocabulary, merges)
        table = byte_characters()
        self.to_bytes = {ord(c): byte for byte, c in enumerate(table)}
        self.to_characters = dict(enumerate(table))
        base = np.zeros(self.merges.size, dtype=bool)
        for name, token in vocabulary.items():
            base[token] = len(name.removesuffix(suffix)) == 1 and self.merges.rank[token] < 0
        sound = self.merges.sound(base)
        names = {name: token for name, token in vocabulary.items() if sound[token]}
        ends = {self._bytes(name.removesuffix(suffix)): token for name, token in names.items() if name.endswith(suffix)}
        inner = {self._bytes(name): token for name, token in names.items() if not (suffix and name.endswith(suffix))}
        self.inner, self.ends, self.longest = inner, ends, max(map(len, inner), default=0)
        self.trie = Trie(inner, ends)
        self.added = {token["content"]: token["id"] for token in added}
        self.special = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if added else None
        # Plain letters are lower-cased pieces only under the rules that this file states.
        tries = {"Ab": ["ab"], "aB.,": ["ab", ".,"], "x?!": ["x", "?!"], "\u00c9a": ["\u00e9a"], "o\u0159\u01cd.": ["o\u0159\u01ce", "."]}
        self.plain = all(self._pieces(text) == [p.encode() for p in pieces] for text, pieces in tries.items())
        # Ids of chunks as little-endian bytes, and how many words of a chunk were merged exactly, if any.
        self.known: dict[str, bytes] = {}
        self.exact: dict[str, int] = {}

    def _bytes(self, characters: str) -> bytes:
        return characters.translate(self.to_bytes).encode("latin-1")

    def _pieces(self, chunk: str) -> list[bytes]:
        """The pieces that the file's own normaliser and splitter make."""
        normalizer, splitter = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        text = normalizer.normalize_str(chunk) if normalizer else chunk
        return [self._bytes(piece) for piece, _ in splitter.pre_tokenize_str(text)] if splitter else [self._bytes(text)]

    def _parts(self, chunk: str) -> list[bytes | int]:
        """Pieces, and ids of added tokens, in order."""
        if self.plain:
            core = chunk.rstrip(STOPS)
            # Composed Latin letters: the same in every version of Unicode, lower case letter by letter.
            if core.isalpha() and (core.isascii() or (max(core) < "\u0250" and "\u0130" not in core)):
                word = core.lower().encode()
                return [word] if len(core) == len(chunk) else [word, chunk[len(core) :].encode()]
        if self.special is None or not self.special.search(chunk):
            return self._pieces(chunk)
        parts, at = [], 0
        for found in self.special.finditer(chunk):
            parts += self._pieces(chunk[at : found.start()]) if found.start() > at else []
            parts.append(self.added[found[0]])
            at = found.end()
        return parts + (self._pieces(chunk[at:]) if at < len(chunk) else [])

    def propose(self, word: bytes) -> list[int]:
        """The cover of one long word; none if a character has no token."""
        inner, ends, found, at, size = self.inner, self.ends, [], 0, len(word)
        while at < size:
            last = ends.get(word[at:])
            if last is not None:
                return [*found, last]
            for upto in range(min(size - 1, at + self.longest), at, -1):
                token = inner.get(word[at:upto])
                if token is not None:
                    found.append(token)
                    at = upto
                    break
            else:
                return []
        return []

    def words(self, words: list[bytes]) -> tuple[list[bytes], np.ndarray]:
        """Little-endian ids of each word, and whether its proposal failed and it was merged exactly."""
        short = [word if len(word) <= LONGEST else b"" for word in words]
        owner, tokens, failed = self.trie.cover(short)
        long = {i: self.propose(word) for i, word in enumerate(words) if len(word) > LONGEST}
        if long:
            owner = np.concatenate([owner, np.repeat(list(long), [len(ids) for ids in long.values()])])
            tokens = np.concatenate([tokens, np.array([t for ids in long.values() for t in ids], dtype=np.int64)])
            failed[list(long)] = [not ids for ids in long.values()]
            order = np.argsort(owner, kind="stable")
            owner, tokens = owner[order], tokens[order]
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        pairs, which = np.unique(tokens[inside] * self.merges.size + tokens[inside + 1], return_inverse=True)
        apart = self.merges.apart(pairs // self.merges.size, pairs % self.merges.size)
        failed[owner[inside[~apart[which]]]] = True
        data, edges = tokens.astype("<i4").tobytes(), (4 * np.searchsorted(owner, np.arange(len(words) + 1))).tolist()
        ids = [data[edges[i] : edges[i + 1]] for i in range(len(words))]
        merge = self.tokenizer.model.tokenize
        for i in np.flatnonzero(failed).tolist():
            found = merge(words[i].decode("latin-1").translate(self.to_characters)) if words[i] else []
            ids[i] = np.array([token.id for token in found], dtype="<i4").tobytes()
        return ids, failed

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Adds the chunks to the known ones; those too long to keep come back."""
        new = [chunk for chunk in chunks if chunk not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            self.exact.clear()
            new = list(chunks)
        parts = [self._parts(chunk) for chunk in new]
        words = list(dict.fromkeys(part for each in parts for part in each if isinstance(part, bytes)))
        ids, failed = self.words(words)
        made = dict(zip(words, ids))
        merged = {word for word, fails in zip(words, failed.tolist()) if fails}
        here = {}
        for chunk, each in zip(new, parts):
            if len(each) == 1 and isinstance(each[0], bytes):
                value, exact = made[each[0]], each[0] in merged
            else:
                value = b"".join([made[p] if isinstance(p, bytes) else p.to_bytes(4, "little") for p in each])
                exact = sum(p in merged for p in each)
            if len(chunk) <= LONGEST:
                self.known[chunk] = value
            else:
                here[chunk] = value
            if exact:
                self.exact[chunk] = int(exact)
        return here

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[int]]:
        """Ids of each text, and how many of its words were merged exactly."""
        cut = [CHUNK.findall(text) for text in texts]
        here = self.learn(set().union(*cut))
        known, exact = self.known, self.exact
        if here:
            joined = [b"".join([known[c] if c in known else here[c] for c in chunks]) for chunks in cut]
        else:
            joined = [b"".join(map(known.__getitem__, chunks)) for chunks in cut]
        counts = [sum([exact[c] for c in chunks if c in exact]) for chunks in cut]
        for chunk in here:
            exact.pop(chunk, None)
        return [np.frombuffer(ids, dtype="<i4") for ids in joined], counts


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


@lru_cache(maxsize=2)
def _names(path: str) -> tuple[str, ...]:
    tokenizer = Tokenizer.from_file(path)
    known = {token: name for name, token in tokenizer.get_vocab(with_added_tokens=True).items()}
    return tuple(known.get(i, "") for i in range(max(known, default=-1) + 1))


def encode_transcripts(transcripts: DataFrame, path: str) -> DataFrame:
    """All columns of the transcripts, and ``token_ids`` (array<int>) of the whole ``text`` and how many of its
    words were ``merged_exactly`` (bigint).

    ``path`` names a tokenizer file of word-end BPE that every executor has. Texts are cut at ASCII white space, which
    the file's rules never join; normalising and cutting into words is the file's own. For each distinct word of a
    batch the longest tokens from left to right are proposed, all neighbouring pairs are checked at once, and words
    with a pair that merging would join are merged step by step. Added tokens of the file are found in the texts.

    Null and empty texts, and texts of white space, have no tokens. Columns named like the two new ones are
    replaced, others pass through. Repeated rows are encoded one by one; an empty table gives no rows.
    """
    rows = transcripts.drop("token_ids", "merged_exactly")
    names = rows.columns
    at = names.index("text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in by_bytes(batches, at, BATCH_BYTES):
            ids, exact = encoder.encode([text or "" for text in batch.column(at).to_pylist()])
            columns = [*batch.columns, list_column(ids), pa.array(exact, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, "token_ids", "merged_exactly"])

    added = [StructField("token_ids", ArrayType(IntegerType(), False)), StructField("merged_exactly", LongType())]
    return rows.mapInArrow(encode, StructType([*rows.schema.fields, *added]))


def decode_tokens(tokens: DataFrame, path: str) -> DataFrame:
    """All columns, and ``decoded`` (string): the vocabulary entries of ``token_ids``, joined by blanks.

    That is what a tokenizer file without a decoder of its own states: entries keep their word ends, and white space
    that encoding dropped does not come back. A column ``decoded`` is replaced. Null ids stay null, no ids give an
    empty text, an id that the file lacks is an error; an empty table gives no rows.
    """
    rows = tokens.drop("decoded")
    columns = rows.columns
    at = columns.index("token_ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _names(path)
        for batch in by_bytes(batches, at, BATCH_BYTES):
            texts = []
            for ids in batch.column(at):
                found = ids.values.to_numpy().tolist() if ids.is_valid else None
                if found and min(found) < 0:
                    raise ValueError("token ids start at 0")
                texts.append(None if found is None else " ".join([names[i] for i in found]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*columns, "decoded"])

    return rows.mapInArrow(decode, StructType([*rows.schema.fields, StructField("decoded", StringType())]))

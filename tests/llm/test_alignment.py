"""Aligned tokens against a comparison of all tokens of a text, and both encodings against their libraries."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from voxtide.llm import alignment
from voxtide.llm.queries import op13_token_alignment

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
A, B = Tokenizer.from_file(BYTES), SentencePieceProcessor(model_file=PIECES)
A.encode_special_tokens = True
SIDES = alignment.ByteSide(BYTES), alignment.PieceSide(PIECES)
ENCODER = alignment.Encoder(*SIDES)
TEXTS = [None, "", " ", "\n", "a b\nc  d\n", "naïve 日本語 😀😀", "<|endoftext|> <s>x</s><unk>", "a▁b", "▁", "x" * 3000, "tab\tand\x00nul", "same words", "same words", "🇩🇪 ﬁ ǆ" * 20]


def spelled(ids, contents):
    at, out = 0, []
    for i in ids:
        out.append((i, at, at + len(contents[i])))
        at += len(contents[i])
    return out


def brute(text):
    """Tokens of both sides, groups as lists of ids, and all links, by comparing everything with everything."""
    if not text:
        return [], [], [], Counter(), 0
    a = spelled(A.encode(" " + text, add_special_tokens=False).ids, SIDES[0].contents)
    b = spelled(B.encode(text), SIDES[1].contents)
    whole = b" " + text.encode()
    if any(b"".join(side.contents[t[0]] for t in tokens) != whole for side, tokens in zip(SIDES, (a, b))):
        return [], [], [], Counter(), 0
    cuts = sorted({t[2] for t in a} & {t[2] for t in b})
    groups, links, at = [], Counter(), 0
    for cut in cuts:
        inside = [[t[0] for t in tokens if at <= t[1] and t[2] <= cut] for tokens in (a, b)]
        groups.append(inside)
        links.update((x, y) for x in inside[0] for y in inside[1])
        at = cut
    overlaps = sum(x[1] < y[2] and y[1] < x[2] for x in a for y in b)
    return a, b, groups, links, overlaps


def text_of(groups):
    return ";".join("|".join(",".join(map(str, side)) for side in group) for group in groups)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet="abcé日 \n\t\x85'1.,😀\x00▁<s>", max_size=30)))
def test_texts_encode_as_by_their_libraries(text):
    check_encoding(ENCODER, text)


def check_encoding(encoder, text):
    a, b = encoder.encode([text, "same"])
    want = [A.encode(" " + text, add_special_tokens=False).ids, B.encode(text)] if text else [[], []]
    spelled_out = all(b"".join(side.contents[i] for i in ids) == b" " + text.encode() for side, ids in zip(SIDES, want))
    assert [a[0].tolist(), b[0].tolist()] == (want if spelled_out else [[], []]) and len(a[1]) and len(b[1])


def test_known_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 3)
    encoder = alignment.Encoder(*SIDES)
    for text in ["one two three four\nfive six", "seven eight\nnine ten\neleven one"] * 2:
        check_encoding(encoder, text)


def test_words_that_a_side_does_not_spell():
    encoder = alignment.Encoder(*SIDES)
    encoder._learn(0, {"fine", "b▁d"})
    assert encoder.misspelt == {"b▁d"}


@pytest.mark.parametrize("most", [1 << 21, 1])
def test_links_of_any_tokens(monkeypatch, most):
    """Made-up tokens, so that groups have many tokens on both sides."""
    monkeypatch.setattr(alignment, "PAIRS", most)
    r = random.Random(8)
    rows = []
    for _ in range(60):
        size = r.randint(0, 40)
        sides = []
        for _ in range(2):
            ends = sorted({*(r.randint(1, size) for _ in range(r.randint(1, 12))), size}) if size else []
            sides.append([(r.randrange(4), s, e) for s, e in zip([0, *ends], ends)])
        rows.append((size, *sides))
    base = np.cumsum([0, *(row[0] for row in rows)])
    frames = []
    for side in (1, 2):
        flat = [(k, t[0], base[k] + t[1], base[k] + t[2]) for k, row in enumerate(rows) for t in row[side]]
        frames.append(alignment.pd.DataFrame(flat, columns=["row", "id", "start", "end"]).astype("int64"))
    a, b = frames
    groups = alignment.grouped(a, b)
    pairs = alignment.overlapping(a, b)
    keys, times = alignment.linked(a, b, pairs, groups, (4, 4))
    links, wide = Counter(), 0
    for k, (size, left, right) in enumerate(rows):
        at = 0
        for cut in sorted({t[2] for t in left} & {t[2] for t in right}):
            inside = [[t[0] for t in side if at <= t[1] and t[2] <= cut] for side in (left, right)]
            wide += min(map(len, inside)) > 1
            links.update((k, x, y) for x in inside[0] for y in inside[1])
            at = cut
    assert {(int(x) // 16, int(x) // 4 % 4, int(x) % 4): int(n) for x, n in zip(keys, times)} == links and wide > 20
    brute_pairs = {(i, j) for i, x in enumerate(a.itertuples()) for j, y in enumerate(b.itertuples()) if x.start < y.end and y.start < x.end}
    assert len(pairs) == len(brute_pairs) and set(map(tuple, pairs.to_numpy().tolist())) == brute_pairs


def expected(texts):
    """Per text: tokens, groups, links, best links, sum of counts, grouping."""
    found = [brute(text) for text in texts]
    held = Counter(pair for _, _, _, links, _ in found for pair in links)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for a, b, groups, links, overlaps in found:
        tops = sum(n for pair, n in links.items() if held[pair] == best[pair[0]])
        total = sum(n * held[pair] for pair, n in links.items())
        out.append((len(a), len(b), len(groups), sum(links.values()), tops, total, text_of(groups), overlaps))
    return out


@pytest.mark.parametrize("head", [alignment.HEAD, 3, 0])
def test_frames(spark, head):
    texts = TEXTS + ["the cat sat", "the cat", "the dog sat on the cat"]
    rows = [(i, t, "g", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_id long, text string, grouping string, tag int")
    aligned = alignment.align_transcripts(df, BYTES, PIECES)
    found = alignment.score_links(aligned, head).collect()
    assert len(found) == len(rows) and {r.tag for r in found} == {7}
    want = expected(texts)
    for r in found:
        assert (r.a_tokens, r.b_tokens, r.groups, r.links, r.best_links, r.count_sum, r.grouping, r.overlaps) == want[r.file_id]
    assert "link_a" not in found[0] and alignment.score_links(aligned.limit(0), head).collect() == []


def test_null_lists_are_scored_as_none(spark):
    df = spark.createDataFrame([(1, None, None, None), (None, [5], [6], [2]), (None, [5], [6], [2])], "file_id long, link_a array<int>, link_b array<int>, link_times array<long>")
    found = sorted(tuple(r)[1:] for r in alignment.score_links(df).collect())
    assert found == [(0, 0), (2, 4), (2, 4)]


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    # Tokens of long texts are too many to compare all with all, so the model of groups alone is used here.
    found = {r.doc_id: r for r in op13_token_alignment(spark, folder).collect()}
    assert found.keys() == texts.keys()
    held, each = Counter(), {}
    for doc_id, text in texts.items():
        a = spelled(A.encode(" " + text, add_special_tokens=False).ids, SIDES[0].contents) if text else []
        b = spelled(B.encode(text), SIDES[1].contents) if text else []
        cuts = {t[2] for t in a} & {t[2] for t in b}
        groups = []
        for side, tokens in enumerate((a, b)):
            k = 0
            for t in tokens:
                if len(groups) <= k:
                    groups.append(([], []))
                groups[k][side].append(t[0])
                k += t[2] in cuts
        links = Counter((x, y) for g in groups for x in g[0] for y in g[1])
        held.update(links.keys())
        each[doc_id] = (a, b, groups, links)
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    for doc_id, (a, b, groups, links) in each.items():
        tops = sum(n for pair, n in links.items() if held[pair] == best[pair[0]])
        total = sum(n * held[pair] for pair, n in links.items())
        digest = hashlib.sha256(text_of(groups).encode()).hexdigest() if a else ""
        assert tuple(found[doc_id])[1:8] == (len(a), len(b), len(groups), sum(links.values()), tops, total, digest)

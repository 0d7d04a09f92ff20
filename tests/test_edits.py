"""Edit distances in tiles against the distance of whole transcripts."""

import random

import pytest

from voxtide.operators.edits import tile, tiled_edits, word_blocks
from voxtide.operators.transcripts import count_edits

TEXTS = "file_id string, idx int, text string"


def altered(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words) + 1)
        words[at : at + rng.randint(0, 2)] = [rng.choice("abcdef") for _ in range(rng.randint(0, 2))]
    return words


def test_tiles_hand_on_their_edges():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
        b = altered(rng, a, rng.randint(0, 20)) or ["a"]
        size = rng.randint(1, 15)
        rows = [a[k : k + size] for k in range(0, len(a), size)]
        columns = [b[k : k + size] for k in range(0, len(b), size)]
        tops, total = [None] * len(columns), len(b)
        for row in rows:
            left = None
            for j, column in enumerate(columns):
                left, tops[j], delta = tile(row, column, left, tops[j])
            total += delta
        assert total == count_edits(a, b)


def frame(spark, sides):
    rows = []
    for name, words in sides.items():
        for idx, at in enumerate(range(0, max(len(words), 1), 7)):
            rows.append((name, idx, " ".join(words[at : at + 7])))
    return spark.createDataFrame(rows, TEXTS)


@pytest.mark.parametrize("size", [5, 4_096])
def test_recordings_of_any_length(spark, size):
    rng = random.Random(size)
    lengths = {"one": 1, "short": 4, "edge": 10, "long": 60, "longer": 83} if size == 5 else {"one": 1, "long": 3_000}
    expected = {name: [rng.choice("abcdef") for _ in range(n)] for name, n in lengths.items()} | {"silent": [], "lost": list("abc")}
    actual = {name: altered(rng, words, len(words) // 4) for name, words in expected.items()} | {"silent": list("xyz"), "lost": []}
    rows = tiled_edits(word_blocks(frame(spark, expected), size=size), word_blocks(frame(spark, actual), size=size)).collect()
    found = {r.file_id: (r.expected_words, r.actual_words, r.word_edits) for r in rows}
    assert found == {n: (len(expected[n]), len(actual[n]), count_edits(expected[n], actual[n])) for n in expected}
    assert tiled_edits(word_blocks(frame(spark, {"x": []})), word_blocks(frame(spark, {"x": []}))).collect() == []


def test_blocks_are_bounded_and_in_order(spark):
    words = [f"w{k}" for k in range(1_000)]
    rows = word_blocks(frame(spark, {"a": words}), size=64).orderBy("block").collect()
    assert [len(r.words) for r in rows] == [64] * 15 + [40] and [w for r in rows for w in r.words] == words

"""Periodic runs against a search of every period word by word."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtide.llm import loops
from voxtide.llm.queries import op12_periodic_runs


def brute_runs(words, least=6, repeats=4):
    found = []
    n = len(words)
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q))
            if length >= max(least, repeats * q) and not smaller:
                found.append((i, length, q))
            i = j + 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def strongest(runs):
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def numbers(rng, n, letters, depth=3):
    """A sequence with loops, and loops of loops."""
    out = [rng.randrange(letters) for _ in range(rng.randint(0, n))]
    for _ in range(depth):
        a = rng.randrange(len(out) + 1)
        piece = out[a : a + rng.randint(1, 9)]
        out[a:a] = piece * rng.randint(1, 7) + piece[: rng.randrange(len(piece) + 1)]
    return out


def as_rows(found):
    return [[tuple(map(int, row)) for row in rows] for rows in found]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=6))
def test_runs_of_few_symbols(sequences):
    found = loops.find_runs([np.array(s, dtype=np.int64) for s in sequences], 6, 4)
    assert as_rows(found) == [brute_runs(s) for s in sequences]


def test_runs_of_loops(monkeypatch):
    rng = random.Random(1)
    sequences = [numbers(rng, 60, rng.choice([1, 2, 4, 40])) for _ in range(300)]
    expected = [brute_runs(s) for s in sequences]
    assert sum(map(len, expected)) > 300
    arrays = [np.array(s, dtype=np.int64) for s in sequences]
    assert as_rows(loops.find_runs(arrays, 6, 4)) == expected
    assert as_rows(loops.find_runs(arrays, 9, 5)) == [brute_runs(s, 9, 5) for s in sequences]
    # The grid in many small pieces.
    monkeypatch.setattr(loops, "GRID_POINTS", 7)
    assert as_rows(loops.find_runs(arrays, 6, 4)) == expected
    with pytest.raises(ValueError):
        loops.find_runs(arrays, 6, 2)


def test_extensions():
    rng = random.Random(2)
    for letters in (1, 2, 5, 3_000_000):
        values = np.array([rng.randrange(letters) for _ in range(400)] * 2 + [letters], dtype=np.int64)
        both = np.array([(i, j) for i in range(0, 801, 3) for j in range(i + 1, 801, 7)])
        found = loops.Extensions(values).of(both[:, 0], both[:, 1])
        listed = values.tolist()
        for (i, j), k in zip(both.tolist(), found.tolist()):
            assert listed[i : i + k] == listed[j : j + k] and listed[i + k : i + k + 1] != listed[j + k : j + k + 1]


def test_cover_reaches_samples_from_any_two_positions():
    steps = loops._steps()
    assert steps.max() < loops.COVER
    assert {(a - b) % loops.COVER for a in loops.RESIDUES for b in loops.RESIDUES} == set(range(loops.COVER))


def test_long_loops():
    word = np.zeros(200_000, dtype=np.int64)
    phrase = np.tile(np.arange(7_000), 20)
    found = loops.find_runs([word, phrase, np.concatenate([phrase, [9]])], 6, 4)
    assert as_rows(found) == [[(0, 200_000, 1)], [(0, 140_000, 7_000)], [(0, 140_000, 7_000)]]


def test_frames(spark):
    texts = [None, "", " \n\t ", "no no no no no no", "a b a b a b a b a", "so\nso so \x0b so so", "x " * 5000, "one two three " * 4, "É é " * 3, "aa bb", "aa bb"]
    rows = [(i, t, "r", 7) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "file_id long, text string, runs string, tag int")
    found = loops.find_loops(df).collect()
    assert len(found) == len(rows) and {r.tag for r in found} == {7}
    for r in found:
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        runs = brute_runs(words) if len(words) < 1000 else [(0, 5000, 1)]
        assert [tuple(x) for x in r.runs] == runs and r.collapsed == brute_collapsed(words, runs)
        assert (tuple(r.strongest) if r.strongest else None) == strongest(runs)
    assert loops.find_loops(df.limit(0)).collect() == []


def test_strongest_is_exact(spark):
    # 13 words of period 3 repeat more often than 17 of period 4, both 4.25 at two digits but for the fraction.
    text = "a b c d " * 4 + "a | " + "x y z " * 4 + "x / " + "p q r " * 4 + "p"
    row = loops.find_loops(spark.createDataFrame([(1, text)], "file_id long, text string")).first()
    assert tuple(row.strongest) == (18, 13, 3) and len(row.runs) == 3


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in op12_periodic_runs(spark, folder).collect()}
    assert found.keys() == texts.keys() and sum(r.n_runs > 0 for r in found.values()) > 10
    for doc_id, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = brute_runs(words) if n < 3000 else as_rows(loops.find_runs(loops._numbered([words]), 6, 4))[0]
        best = strongest(runs)
        expected = (len(runs), *(best or (None, None, None)), 1000 * best[1] // best[2] if best else None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, brute_collapsed(words, runs))]
        assert tuple(found[doc_id])[1:] == (*expected, *digests)

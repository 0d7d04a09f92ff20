"""Word BPE against the tokenizers library, which merges every word step by step."""

import hashlib
import json
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from voxtide.llm import word_bpe
from voxtide.llm.queries import op11_word_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY, ENCODER = Tokenizer.from_file(PATH), word_bpe.WordEncoder(PATH)
ODD = "abcdeéÀİßſK'’s1 2\n\t\x0b\x85 ẛ̣̇日本😀ΣσςaeiourntESTing.,-<|>\x1c\x00"
PARTS = [*ODD, "<|startoftext|>", "<|endoftext|>", "'s", "'LL", "ing", "tion", "the", "ther", "anan", "aaaa"]
TEXTS = [None, "", " ", "\n\t", "One one ONE", "<|endoftext|> a<|startoftext|>b <|EndOfText|>", "x" * 9000, "ab" * 70, "naïve Ünïcödé, łódź.", "á ́b"]


def by_library(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=600, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PARTS), st.text(max_size=6)), max_size=25).map("".join))
def test_ids_are_those_of_the_library(text):
    ids, _ = ENCODER.encode([text])
    assert ids[0].tolist() == by_library(text)


@pytest.mark.parametrize("letters, longest", [("ab", 40), ("aeinrsthlo", 16), ("thean", 12)])
def test_words_of_few_letters(letters, longest):
    r = random.Random(5)
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, longest))) for _ in range(4000)] + [letters[0] * k for k in range(1, 200)]
    found, exact = ENCODER.encode(words)
    assert [i.tolist() for i in found] == [e.ids for e in LIBRARY.encode_batch(words, add_special_tokens=False)]
    # Both ways are used: proposals that stand, and words merged exactly.
    assert 0 < sum(exact) < len(words)


def test_pairs_stay_apart_exactly_if_they_encode_to_themselves():
    r = random.Random(6)
    inner, ends = list(ENCODER.inner.items()), list(ENCODER.ends.items())
    sides = [(r.choice(inner), r.choice(ends)) for _ in range(3000)]
    apart = ENCODER.merges.apart(np.array([a[1] for a, _ in sides]), np.array([b[1] for _, b in sides]))
    for ((a, i), (b, j)), found in zip(sides, apart.tolist()):
        piece = (a + b).decode("latin-1").translate(ENCODER.to_characters)
        assert found == ([t.id for t in LIBRARY.model.tokenize(piece)] == [i, j])


def test_long_words_are_proposed_alike():
    r = random.Random(7)
    words = ["".join(r.choice("tion ers").strip() or "a" for _ in range(r.randint(1, 30))).encode() for _ in range(300)] + [b"\xff\x00"]
    owner, tokens, failed = ENCODER.trie.cover(words)
    assert [tokens[owner == i].tolist() for i in range(len(words))] == [ENCODER.propose(word) for word in words] and not failed.any()


def test_known_chunks_are_forgotten(monkeypatch):
    monkeypatch.setattr(word_bpe, "REMEMBERED", 4)
    encoder = word_bpe.WordEncoder(PATH)
    for text in ["one two three, four", "five six seven eight nine ten", "one <|endoftext|>x"] * 2:
        ids, _ = encoder.encode([text, "one"])
        assert [i.tolist() for i in ids] == [by_library(text), by_library("one")]


def test_files_the_method_does_not_cover(tmp_path):
    stated = json.load(open(PATH))
    stated["model"]["ignore_merges"] = True
    (tmp_path / "other.json").write_text(json.dumps(stated))
    with pytest.raises(ValueError, match="no plain BPE"):
        word_bpe.WordEncoder(str(tmp_path / "other.json"))


def test_frames(spark):
    rows = [(i, t, "x", 7) for i, t in enumerate([*TEXTS, "same", "same"])]
    df = spark.createDataFrame(rows, "file_id long, text string, token_ids string, tag int")
    coded = word_bpe.decode_tokens(word_bpe.encode_transcripts(df, PATH).withColumn("decoded", F.col("tag")), PATH)
    found = coded.collect()
    assert len(found) == len(rows) and {r.tag for r in found} == {7}
    for r in found:
        assert r.token_ids == by_library(rows[r.file_id][1])
        assert r.decoded == LIBRARY.decode(r.token_ids, skip_special_tokens=False)
    assert word_bpe.decode_tokens(word_bpe.encode_transcripts(df.limit(0), PATH), PATH).collect() == []
    nulls = spark.createDataFrame([(1, None), (2, [])], "file_id long, token_ids array<int>")
    assert {r.file_id: r.decoded for r in word_bpe.decode_tokens(nulls, PATH).collect()} == {1: None, 2: ""}
    with pytest.raises(Exception, match="start at 0"):
        word_bpe.decode_tokens(spark.createDataFrame([(1, [-1])], "file_id long, token_ids array<int>"), PATH).collect()


def test_query_on_the_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    found = {r.doc_id: r for r in op11_word_bpe(spark, folder).collect()}
    assert found.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = by_library(text)
        decoded = LIBRARY.decode(ids, skip_special_tokens=False)
        expected = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        assert tuple(found[doc_id])[1:4] == expected

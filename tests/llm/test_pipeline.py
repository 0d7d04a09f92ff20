"""The stages against brute-force versions, the registered queries, and awkward tables."""

import os
import sys

import pytest
from test_texts import groups_of, lines_kept, measures, print_of

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import corpus_pipeline  # noqa: E402
from oracle_check import compare, connect  # noqa: E402

from voxtide.llm.oracles import ORACLES  # noqa: E402
from voxtide.llm.queries import QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def connection():
    return connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    _, rows, problem = compare(spark, connection, SF, name, QUERIES[name], ORACLES.get(name))
    assert not problem and rows > 0


def failed(text):
    words, _, _, _, repeated = measures(text)
    return words < 50 or 100 * repeated > 50 * words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    good = corpus_pipeline.quality(spark, docs, SF)
    assert {r.doc_id for r in good.collect()} == {r["doc_id"] for r in rows if not failed(r["text"])}
    cut = corpus_pipeline.lines(spark, good, SF)
    want = lines_kept([(r["doc_id"], r["text"]) for r in rows if not failed(r["text"])])
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts == {i: t for i, (_, _, t) in want.items()}
    first = corpus_pipeline.near_copies(spark, cut, SF)
    label = groups_of({i: print_of(t) for i, t in texts.items()}, 4)
    assert sorted(r.doc_id for r in first.collect()) == sorted(i for i in label if label[i] == i)
    mixed = corpus_pipeline.mixing(spark, first, SF)
    assert 0 < mixed.count() < first.count() and mixed.columns == list(corpus_pipeline.COLUMNS)
    out = corpus_pipeline.tokens(spark, mixed, SF)
    assert out.count() == mixed.count() and out.filter("not round_trip or n_tokens < 1").count() == 0


def test_awkward_tables(spark):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(1, long, "en", "a", 1), (1, long, "en", "a", 1), (2, long + " end", "en", None, None), (None, long, None, "a", 3), (None, None, None, None, None)]
    rows += [(3, None, "en", "a", 0), (4, "", "en", "a", 0), (5, " ".join(f"v{i}" for i in range(60_000)), "en", "a", 9)]
    for docs in (spark.createDataFrame([(*r, 7) for r in rows], SCHEMA + ", file_id int"), spark.createDataFrame([], SCHEMA)):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, SF)
            if name != "byte_bpe":
                assert made.columns == list(corpus_pipeline.COLUMNS)
            found = made.collect()
            if docs.columns[-1] == "file_id" and name == "simhash":
                assert sorted(r.doc_id or 0 for r in found) == [0, 0, 1, 2, 3, 5]
            if docs.columns[-1] == "file_id" and name == "quality_rules":
                assert sorted(r.doc_id or 0 for r in found) == [0, 1, 1, 2, 5]

"""Literal cases for text, timestamps, captions and transcripts."""

import random
import tracemalloc
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from voxtide.functions import paths, scalars, text, timecode
from voxtide.operators.cues import assemble_documents, clamp_cues, parse_documents
from voxtide.operators import transcripts
from voxtide.operators.transcripts import accumulate_transcripts, count_edits, fold_text
from voxtide.options import DetectorOptions, SegmenterOptions
from voxtide.plans.evaluate import evaluate_documents


def values(spark, column, inputs, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in df.select("i", column(F.col("v")).alias("out")).orderBy("i").collect()]


def test_time_conversions(spark):
    assert values(spark, timecode.samples_to_ms, [0, 7, 8, 16_000, 1_600_008], "bigint") == [0, 0, 1, 1_000, 100_001]
    shown = values(spark, timecode.format_timestamp, [0, 3_723_004, 97_200_999, 360_000_000], "bigint")
    assert shown == ["00:00:00.000", "01:02:03.004", "27:00:00.999", "100:00:00.000"]
    for f in (timecode.samples_to_ms, timecode.format_timestamp):
        with pytest.raises(Exception, match="cannot be negative"):
            values(spark, f, [-1], "bigint")
    bad = ["1:00:00.000", "00:60:00.000", "00:00:61.000", "00:00:00.00", "00:00:00,000", "00:00.000", " 00:00:00.000",
           "99999999999999999999:00:00.000", "9999999999999:00:00.000", "٠٠:00:00.000"]
    assert values(spark, timecode.parse_timestamp, bad) == [None] * len(bad)
    assert values(spark, timecode.parse_timestamp, ["00:00:01.500", "123:59:59.999"]) == [1_500, 446_399_999]
    assert values(spark, timecode.format_duration, [-3.0, 59.9, 600.0, 3_600.0, 90_061.0], "double") == ["0:00", "0:59", "10:00", "1:00:00", "25:01:01"]


def test_text_cleaning(spark):
    assert values(spark, text.sanitize_text, [None, " \t\n", "  a\r\n b\u00a0c ", "x --> y", "e\u0301"]) == ["", "", "a b c", "x → y", "é"]
    got = values(spark, text.normalize_text, ["Hello,  WORLD!", "ﬁn “quoted” ½", "$5 + 3", "ΟΔΟΣ", "A\u2003B"])
    assert got == ["hello world", "fin quoted 1⁄2", "$5 + 3", "οδοσ", "a b"]
    assert values(spark, text.tokenize, ["", " ! ", "a-b c"]) == [[], [], ["ab", "c"]]
    long = "x" * 181
    assert values(spark, text.compact_message, ["a \n b", "y" * 180, long]) == ["a b", "y" * 180, "x" * 179 + "…"]
    heads = ["WEBVTT", "\ufeffWEBVTT x", "WEBVTTx", " WEBVTT", ""]
    assert values(spark, lambda c: text.has_vtt_header(c, False), heads) == [True, True, True, False, False]
    assert values(spark, text.has_vtt_header, heads) == [True, True, False, False, False]
    assert values(spark, text.is_sha256, ["a" * 64, "A1" * 32, "g" * 64, "a" * 63, None]) == [True, True, False, False, False]


def test_paths(spark):
    assert values(spark, paths.relative_output_path, ["a/b.mp4", "a.b/c", "x.tar.MP4"]) == ["a/b.vtt", "a.b/c.vtt", "x.tar.vtt"]
    inside = ["a/../b", "./a", "a/b/../../c"]
    outside = ["..", "../a", "..\\a", "/a", "C:\\a", "a/../../b"]
    assert values(spark, paths.escapes_root, inside + outside) == [False] * 3 + [True] * 6
    bad = ["a ", "a.", "a:b", "con", "NUL.txt", "lpt3.log", "a\tb", "q?"]
    assert values(spark, paths.windows_safe_segment, bad + ["com0", "console", "con.tar.gz", "é a"]) == [False] * 8 + [True] * 4


def test_scalars(spark):
    nan, inf = float("nan"), float("inf")
    assert values(spark, scalars.normalize_progress, [None, nan, inf, -inf, -0.5, 0.25, 7.0], "double") == [None] * 4 + [0.0, 0.25, 1.0]
    assert values(spark, lambda c: scalars.safe_percent(c, F.lit(4)), [1, 0], "int") == [25.0, 0.0]
    assert values(spark, lambda c: scalars.safe_percent(F.lit(3), c), [0, 6], "int") == [0.0, 50.0]


CUES = "file_id bigint, cue_idx bigint, start_sample bigint, end_sample bigint, text string"


def test_caption_documents(spark):
    rows = [(1, 0, 16_000, 32_000, "second"), (1, 1, 0, 16_000, "first"), (1, 2, 5, 5, "invalid"), (1, 3, 40_000, 48_000, " \n"),
            (2, 0, 0, 16, "a"), (2, 1, 8, 24, "b")]
    cues = clamp_cues(spark.createDataFrame(rows, CUES))
    files = spark.createDataFrame([(1,), (2,), (3,)], "file_id bigint")
    docs = {r.file_id: r for r in assemble_documents(cues, files).collect()}
    assert docs[1].text == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nfirst\n\n00:00:01.000 --> 00:00:02.000\nsecond\n\n"
    assert docs[2].text == "WEBVTT\n\n00:00:00.000 --> 00:00:00.001\na\n\n00:00:00.001 --> 00:00:00.002\nb\n\n"
    assert (docs[3].text, docs[3].cue_count) == ("WEBVTT\n\n", 0)


def test_clamping_in_blocks_matches_the_recursion(spark):
    rng = random.Random(4)
    rows, expected = [], []
    for f in range(8):
        at, cues = 0, []
        for i in range(120):
            at = max(0, at + rng.randint(-200, 400))
            cues.append((f, i, at, at + rng.randint(-5, 60), rng.choice(["x", "", "y z"])))
        rows += cues
        kept = sorted((c[2], c[3], c[1], c[4]) for c in cues if c[3] > c[2] and c[4])
        end = 0
        for n, (s, e, _, t) in enumerate(kept, 1):
            start = max(end, (s * 1_000 + 8_000) // 16_000)
            end = max(start + 1, (e * 1_000 + 8_000) // 16_000)
            expected.append((f, n, start, end, t))
    df = spark.createDataFrame(rows, CUES)
    for block in (None, 500):
        got = sorted(tuple(r) for r in clamp_cues(df, normalized=True, block_samples=block).collect())
        assert got == expected
    parts = assemble_documents(clamp_cues(df, normalized=True), part_cues=7)
    assert parts.groupBy("file_id").count().filter("count > 5").count() == 8
    back = parse_documents(parts).selectExpr("file_id", "start_ms", "end_ms", "text", "error").collect()
    assert sorted(tuple(r) for r in back) == sorted((f, s, e, t, None) for f, _, s, e, t in expected)


def test_accumulation(spark):
    cases = [["a", "b"], ["a", "b", "ab"], ["ab", "abcd"], ["abc", "ab"], ["abc", "bcd"], ["", "x", "  "], ["a", "x", "a", "axay", "axaz"]]
    rng = random.Random(9)
    for _ in range(60):
        said = [rng.choice(["a", "b", "ab", "ba"]) for _ in range(rng.randint(1, 30))]
        for i in range(len(said)):
            if rng.random() < 0.3:
                said[i] = "".join(said[:i]) + rng.choice(["", "a", "b"])
        cases.append(said)
    rows = [(i, j, t) for i, c in enumerate(cases) for j, t in enumerate(c)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "session_id bigint, seq bigint, text string")
    expected = {}
    for i, case in enumerate(cases):
        whole = ""
        for t in case:
            if not t.strip():
                continue
            if t == whole or whole.startswith(t):
                continue
            whole = t if t.startswith(whole) else whole + t
        expected[i] = whole
    assert expected[0] == expected[1] == "ab" and expected[2] == "abcd" and expected[3] == "abc" and expected[4] == "abcbcd"
    for block in (3, 4_096):
        got = {r.session_id: r.transcript for r in accumulate_transcripts(df, run_block=block).collect()}
        assert got == {k: v for k, v in expected.items() if v}
    assert fold_text("ab", "a") == "ab" and fold_text("", "a") == "a"


def test_count_edits():
    def table(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(2)
    for _ in range(1_500):
        a, b = (["abcd"[rng.randrange(4)] for _ in range(rng.randint(0, 14))] for _ in range(2))
        assert count_edits(a, b) == table(a, b)
    a, b = ([str(rng.randrange(30)) for _ in range(n)] for n in (150, 170))
    assert count_edits(a, b) == table(a, b)


def test_options_are_validated():
    for bad in ({"onset_frames": 0}, {"silence_frames": 0}, {"pre_roll": -1}, {"max_segment": 0}, {"split_overlap": 400_000}):
        with pytest.raises(ValueError):
            SegmenterOptions(**bad)
    for bad in ({"frame_samples": 0}, {"initial_floor": 1.0}, {"min_floor": float("nan")}, {"min_floor": -10.0}, {"initial_floor": -95.0},
                {"adaptation": 1.5}, {"on_margin": 7.0}, {"min_on": -60.0}):
        with pytest.raises(ValueError):
            DetectorOptions(**bad)
    assert not DetectorOptions().forced_piece_can_fail


@pytest.mark.parametrize("part_cues", [1, 2, 3, 100])
def test_documents_read_alike_however_they_are_cut(spark, part_cues):
    cues = [(f, n, n * 100, n * 100 + 90, f"text {n}") for f in (1, 2, 3) for n in range(1, 8)]
    cues = [(f, n, 10 if (f, n) == (2, 5) else s, e, t) for f, n, s, e, t in cues]
    df = spark.createDataFrame(cues, "file_id long, cue_no long, start_ms long, end_ms long, text string")
    documents = assemble_documents(df, part_cues=part_cues)
    headless = (F.col("file_id") == 3) & (F.col("part_no") == 0)
    documents = documents.withColumn("text", F.when(headless, F.concat(F.lit("X"), "text")).otherwise(F.col("text")))
    found = sorted((r.file_id, r.cue_no, r.start_ms, r.error) for r in parse_documents(documents).collect() if r.file_id < 3)
    assert found == [(f, n, s, "regressing cue" if (f, n) == (2, 5) else None) for f, n, s, _, _ in cues if f < 3]
    last = [(r.cue_no, r.error) for r in parse_documents(documents).filter("file_id = 3").collect()]
    assert last == [(1, "no WEBVTT header")]


def test_long_document_against_itself(spark):
    n = 4_200
    cues = spark.range(1, n + 1).selectExpr("1L AS file_id", "id AS cue_no", "id * 100 AS start_ms", "id * 100 + 90 AS end_ms", "'word' AS text")
    spoken = cues.selectExpr("file_id", "CAST(cue_no AS INT) AS idx", "start_ms * 16 AS start_sample", "end_ms * 16 AS end_sample", "text")
    found = evaluate_documents(spoken, parse_documents(assemble_documents(cues))).first()
    assert (found.word_edits, found.actual_words, found.produced_without_overlap, found.error) == (0, n, 0, None)


def test_a_batch_is_never_all_python_strings():
    """What an Arrow batch holds is taken apart a few texts at a time."""
    texts = pa.array([None if k % 7 == 0 else "e\u0301 ne" * 400 for k in range(4_000)])
    words = pa.array([["w%d" % (k % 7)] * 200 + [str(k)] for k in range(4_000)])
    normal, edits = text._normalizer("NFC").func, transcripts._word_edits.func
    tracemalloc.start()
    found, distances = normal(texts), edits(words, words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 << 20 and distances.to_pylist() == [0] * 4_000
    assert found.to_pylist() == [None if v is None else unicodedata.normalize("NFC", v) for v in texts.to_pylist()]
    assert normal(texts.slice(0, 0)).to_pylist() == []

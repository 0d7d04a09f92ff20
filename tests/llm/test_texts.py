"""Quality rules, line dedup, SimHash, mixing and BPE against brute-force versions and on awkward input."""

import base64
import hashlib
import random
import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from voxtide.llm import byte_bpe, line_dedup, quality_rules, raking, simhash
from voxtide.llm.components import connected

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
BLANK = " \t\n\x0b\f\r"
AWKWARD = [None, "", " ", "\n", "\n\n \x0b", "one", "a b c a b c a b c", "É é É", "x" * 5000, "deux\nmots\ndeux\n deux"]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def measures(text):
    text = text or ""
    words = words_of(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    inside = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.strip(BLANK)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def some_texts(seed, n=120):
    r = random.Random(seed)
    return [" ".join(r.choice(["ab", "b", "ça", "d#", "e\n", "<f>"]) for _ in range(r.randint(0, 90))) for _ in range(n)]


def test_measures(spark):
    texts = AWKWARD + some_texts(1)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, text string")
    rows = quality_rules.measured(df, ["file_id"]).collect()
    assert {r.file_id: tuple(r)[1:] for r in rows} == {i: measures(t) for i, t in enumerate(texts)}


def test_measures_when_packed_hashes_clash(spark, monkeypatch):
    # Next to nothing is left of the hash beside the position, so most windows need their whole hash.
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 60)
    texts = some_texts(2)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, text string")
    rows = quality_rules.measured(df, ["file_id"]).collect()
    assert {r.file_id: tuple(r)[1:] for r in rows} == {i: measures(t) for i, t in enumerate(texts)}


def test_folder_verdict(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "short"
    rows = [(i, "good", good if i % 10 else bad) for i in range(60)] + [(100 + i, "bad", bad if i < 95 else good) for i in range(100)]
    rows += [(300, None, good), (300, None, good), (None, "good", None)]
    df = spark.createDataFrame([(*r, "extra", 1) for r in rows], "file_id long, folder string, text string, kept string, words int")
    found = quality_rules.judge_transcripts(df).collect()
    assert len(found) == len(rows)
    kept = {(r.file_id, r.folder): r.kept for r in found}
    assert kept[1, "good"] and not kept[0, "good"] and not kept[199, "bad"] and kept[300, None] and not kept[None, "good"]
    rates = {r.folder: r.folder_rate for r in found}
    assert rates["good"] > 7 / 61 and rates["bad"] < 0.95 and 0 < rates[None] < 1
    assert quality_rules.judge_transcripts(df.limit(0)).collect() == []


def lines_kept(rows, least=20, files=3):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(BLANK))
    holders = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            holders[key(line)].add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= least and len(v) >= files}
    out = {}
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for x in lines if not (key(x) in gone and i < gone[key(x)])]
        out[i] = (len(lines), len(lines) - len(keep), "\n".join(keep))
    return out


def test_line_dedup(spark):
    r = random.Random(3)
    pool = ["A line that Many documents share", "\t a line that many documents share ", "another one of twenty ch", "short", "", "Ünique Ähnlich ÄÖÜ ßßßßßß", "x" * 20]
    rows = [(i, "\n".join(r.choice([*pool, f"only in document number {i}"]) for _ in range(r.randint(1, 9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n"), (103, "x" * 20 + "\n" + "x" * 20)]
    df = spark.createDataFrame([(*x, "l", 7) for x in rows], "file_id long, text string, lines string, tag int")
    found = line_dedup.drop_shared_lines(df)
    assert {x.file_id: (x.lines, x.dropped, x.text or "") for x in found.collect()} == lines_kept(rows)
    assert {"tag", "keep_bitmap"} <= set(found.columns) and found.filter("file_id = 100").first().text is None
    assert line_dedup.drop_shared_lines(df.limit(0)).collect() == []


def test_line_dedup_with_equal_ids(spark):
    line = "this is a line of more than twenty characters"
    rows = [(1, line), (1, "x\n" + line), (2, line), (3, line + "\nend"), (None, line)]
    found = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "file_id long, text string")).collect()
    assert sorted((r.file_id or 0, r.text) for r in found) == sorted([(1, ""), (1, "x"), (2, ""), (3, line + "\nend"), (0, line)])


def test_line_dedup_by_a_shuffled_join(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", 0)
    rows = [(i, f"the same long line everywhere\nmine {i}") for i in range(40)]
    found = line_dedup.drop_shared_lines(spark.createDataFrame(rows, "file_id long, text string")).collect()
    assert {r.file_id: r.text for r in found if r.file_id > 37} == {38: "mine 38", 39: rows[39][1]}


def print_of(text, width=4):
    words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words_of(text)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(prints, distance):
    label = dict.fromkeys(prints)
    for i in prints:
        label[i] = i
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("segments, crowded", [(3, 2000), (2, 2000), (5, 2000), (3, 1)])
def test_simhash(spark, segments, crowded):
    r = random.Random(4)
    base = [f"w{r.randint(0, 999)}" for _ in range(150)]
    texts = {i: t for i, t in enumerate(AWKWARD)}
    for i in range(20, 90):
        words = list(base) if i % 3 else [f"v{r.randint(0, 999)}" for _ in range(40)]
        for _ in range(i % 4):
            words[r.randrange(len(words))] = f"n{i}"
        texts[i] = " ".join(words)
    df = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "file_id long, text string, fingerprint string")
    found = simhash.near_transcripts(df, segments=segments, crowded=crowded).collect()
    prints = {i: print_of(t) for i, t in texts.items()}
    assert {x.file_id: x.fingerprint & (1 << 64) - 1 for x in found} == prints
    assert {x.file_id: x.component_id for x in found} == groups_of(prints, 4)
    assert len(set(groups_of(prints, 4).values())) < len(texts) - 10


def test_simhash_edges(spark):
    rows = [(5, "same words here now"), (5, "same words here now"), (None, "same words here now"), (7, None)]
    found = simhash.near_transcripts(spark.createDataFrame(rows, "file_id long, text string"))
    assert sorted((r.file_id or 0, r.component_id) for r in found.collect()) == [(0, 5), (5, 5), (5, 5), (7, 7)]
    assert simhash.near_transcripts(spark.createDataFrame([], "file_id long, text string")).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, j) for j in range(1001, 1100)] + [(5, 5), (None, 3), (2000, 1999)]
    found = {r.id: r.component_id for r in connected(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, **{j: 1000 for j in range(1001, 1100)}, 2000: 1999}


def own_encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


OWN, ENCODER = own_encoding(), byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="ab.,' \n\té1日😀 \u0085\x1c", max_size=30)))
def test_bpe_is_that_of_the_ranks(text):
    ids = ENCODER.encode(text)
    assert ids.tolist() == OWN.encode_ordinary(text)
    assert b"".join(byte_bpe.token_bytes(PATH)[i] for i in ids) == text.encode()


def test_bpe_forgets(monkeypatch):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 5)
    encoder = byte_bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for text in ["one two, three. four", "five six seven eight nine ten, one", "one\ntwo\nthree 1 2 3 4 5 6 7"] * 2:
        assert encoder.encode(text).tolist() == OWN.encode_ordinary(text)


def test_bpe_frames(spark):
    texts = [*AWKWARD, "naïve 😀😀 日本語 <|endoftext|>", "a" * 3000, "same", "same"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "file_id long, text string, content string")
    coded = byte_bpe.decode_tokens(byte_bpe.encode_transcripts(df, PATH, public_tokenizers.PATTERN), PATH)
    for r in coded.collect():
        text = texts[r.file_id] or ""
        assert r.token_ids == OWN.encode_ordinary(text) and bytes(r.content) == text.encode() and r.decoded == text
        place, starts = 0, []
        for i in r.token_ids:
            starts.append(len(text.encode()[: place + 1].decode(errors="replace")) - 1)
            place += len(byte_bpe.token_bytes(PATH)[i])
        assert r.char_starts == starts
    halves = [[i] for i in OWN.encode_ordinary("日本語😀")]
    split = byte_bpe.decode_tokens(spark.createDataFrame([(h,) for h in halves], "token_ids array<int>"), PATH).collect()
    assert b"".join(bytes(r.content) for r in split).decode() == "日本語😀" and any("�" in r.decoded for r in split)
    assert coded.limit(0).collect() == []
    assert byte_bpe.decode_tokens(spark.createDataFrame([(None,), ([],)], "token_ids array<int>"), PATH).collect()[0].content is None


def mix_rows():
    r = random.Random(5)
    rows = []
    for i in range(3000):
        folder = "hot" if r.random() < 0.4 else r.choice(["a", "b", None])
        rows.append((i, folder, r.choice(["en", "en", "de"]), r.choice(["prose", "prose", "table"]), r.randint(1, 500)))
    return rows


def test_raking_meets_the_margins(spark):
    rows = mix_rows()
    df = spark.createDataFrame(rows, "file_id long, folder string, language string, topic string, tokens long")
    targets = {"folder": {"hot": 1, "a": 1, "b": 1, None: 1}, "language": {"en": 3, "de": 2}, "topic": 0.5}
    found = raking.mix_transcripts(df, targets, share=0.3).collect()
    mass = Counter()
    own = Counter()
    for r in found:
        own[r.topic] += r.tokens
        for m in ("folder", "language", "topic"):
            mass[m, r[m]] += r.tokens * r.weight
    total = sum(r.tokens for r in found)
    for value in ("hot", "a", "b", None):
        assert abs(mass["folder", value] / total - 0.25) < 1e-4
    assert abs(mass["language", "en"] / total - 0.6) < 1e-4
    root = {k: v**0.5 for k, v in own.items()}
    assert abs(mass["topic", "table"] / total - root["table"] / sum(root.values())) < 1e-4
    expected = sum(r.tokens * r.probability for r in found)
    assert abs(expected / total - 0.3) < 1e-6 and abs(sum(r.tokens for r in found if r.sampled) / total - 0.3) < 0.03
    for r in found[:50]:
        draw = int(hashlib.md5(f"0:{r.file_id}".encode()).hexdigest()[:12], 16) / (1 << 48)
        assert r.sampled == (draw < r.probability)


def test_mixing_edges(spark, monkeypatch):
    schema = "file_id long, folder string, language string, topic string, tokens long, weight string"
    rows = [(1, None, None, None, None, "w"), (None, "a", "en", "t", -3, "w"), (2, "a", "en", "t", 10, "w"), (2, "a", "en", "t", 10, "w")]
    monkeypatch.setattr(raking, "BROADCAST_CELLS", 0)
    found = raking.mix_transcripts(spark.createDataFrame(rows, schema), {m: 1.0 for m in ("folder", "language", "topic")}, share=1.0)
    assert found.count() == 4 and found.filter("sampled").count() >= 2
    assert raking.mix_transcripts(spark.createDataFrame([], schema), {"folder": 1.0, "language": {"en": 1}}).collect() == []
    # A value without a weight is never drawn, and targets that no mix can meet end.
    some = spark.createDataFrame([(i, "a" if i % 2 else "b", "en", "t", 5, "w") for i in range(40)], schema)
    drawn = raking.mix_transcripts(some, {"folder": {"a": 1}, "language": {"de": 1}}, sweeps=5).filter("sampled").collect()
    assert all(r.folder == "a" for r in drawn)


def test_topics(spark):
    df = spark.createDataFrame([("a | b",), ("me@x",), ("plain",), (None,)], "text string")
    topics = {"contact": ("@",), "table": (" | ",)}
    assert [r[0] for r in df.select(raking.topic_of(df.text, topics)).collect()] == ["table", "contact", "prose", "prose"]


def test_texts_with_more_windows_than_positions_fit(spark, monkeypatch):
    monkeypatch.setattr(quality_rules, "PLACE_BITS", 8)
    r = random.Random(9)
    texts = [" ".join([f"w{r.randrange(100_000)}" for _ in range(300)] + ["a b c", *(f"v{r.randrange(100_000)}" for _ in range(297)), "a b c"]) for _ in range(20)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "file_id long, text string")
    rows = quality_rules.measured(df, ["file_id"]).collect()
    assert {r.file_id: tuple(r)[1:] for r in rows} == {i: measures(t) for i, t in enumerate(texts)} and all(r.repeated_words == 6 for r in rows)


@pytest.mark.parametrize("distance", [1, 2, 3, 5])
def test_crowded_entries_at_any_distance(spark, distance):
    r = random.Random(distance)
    prints = set()
    for base in (r.getrandbits(63), r.getrandbits(63)):
        for _ in range(40):
            value = base
            for _ in range(r.randint(0, 4)):
                value ^= 1 << r.randrange(12)
            prints.add(value)
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    links = simhash.fingerprint_links(df, distance, segments=4, crowded=2)
    found = {x.id: x.component_id for x in connected(links, "a", "b").collect()}
    want = groups_of({p: p for p in prints}, distance)
    assert {p: found.get(p, p) for p in prints} == want


def test_ids_of_any_type(spark):
    rows = [("/in/b.mp4", "same words here now"), ("/in/a.mp4", "same words here now"), (None, "same words here now"), ("/in/c.mp4", None)]
    found = simhash.near_transcripts(spark.createDataFrame(rows, "file_id string, text string")).collect()
    assert sorted((r.file_id or "", r.component_id) for r in found) == [("", "/in/a.mp4"), ("/in/a.mp4", "/in/a.mp4"), ("/in/b.mp4", "/in/a.mp4"), ("/in/c.mp4", "/in/c.mp4")]


def test_fitting_that_does_not_converge_says_so(spark):
    rows = [("a", "x", 10), ("b", "y", 10)]
    cells = spark.createDataFrame(rows, "folder string, language string, tokens long")
    off = raking.rake(cells, {"folder": {"a": 1, "b": 3}, "language": {"x": 3, "y": 1}}, sweeps=4).first().margin_error
    fits = raking.rake(cells, {"folder": {"a": 1, "b": 3}, "language": {"x": 1, "y": 3}}).first().margin_error
    assert off > 0.1 and fits <= 1e-6

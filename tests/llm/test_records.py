"""Pages, vectors, calls, surrogates and archives against brute-force versions and on awkward input."""

import hashlib
import json
import random
import re

import numpy as np
import pytest
import zstandard

from voxtide.llm import archives, surrogates, tool_links, vector_dedup, wrappers

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    '<header>Site</header><nav><ul>{menu}</ul></nav><div class="ad">Buy</div><article><h1>{title}</h1>{paragraphs}'
    '<section class="comments"><p>First!</p></section></article><aside>Side</aside><footer>&copy; x</footer></body></html>'
)


def page(n, title, paragraphs, tag="p"):
    menu = "".join(f"<li><a href='/{i}'>m{i}</a></li>" for i in range(n))
    return PAGE.format(menu=menu, title=title, paragraphs="".join(f"<{tag}>{p}" for p in paragraphs))


def test_pages(spark):
    rows = [(i, f"http://Host{i % 2}.example/{i}", page(1 + i % 4, f"T {i}", [f"a{i} <b>b</b>&amp;\n c", "d<br>e"] * (1 + i % 3))) for i in range(40)]
    rows += [
        (100, None, "<p>one&nbsp;&lt;x&gt;<p>two"),
        (101, "no url", ""),
        (102, "http://host0.example/x", None),
        (None, "http://host0.example/y", "<div>text <!-- no --> here<script>no</script></div><div class='sidebar'>no</div>"),
        (103, "https://u@host0.example:80/z", "<main><p>in main</main><p>outside"),
        (104, "http://host1.example/v", "<article>" + "<p>word " * 30_000 + "</article>"),
        (105, "http://host1.example/w", "a < b & c"),
        (105, "http://host1.example/w", "a < b & c"),
    ]
    df = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in wrappers.extract_pages(df).collect()}
    for i in range(40):
        assert found[i].text == "\n".join([f"T {i}", *[f"a{i} b& c", "d e"] * (1 + i % 3)])
        assert found[i].host == f"host{i % 2}.example"
    assert sum(found[i].fitted for i in range(40)) >= 38
    assert found[100].text == "one <x>\ntwo" and found[101].text == "" and found[102].text == "" and found[None].text == "text here"
    assert found[103].text == "in main" and found[103].host == "host0.example" and found[105].text == "a < b & c"
    assert found[104].text.count("word") == 30_000
    assert wrappers.extract_pages(df).count() == len(rows) and wrappers.extract_pages(df.limit(0)).collect() == []


def test_wrapper_is_union_free_and_general():
    pages = [page(n, "t", ["x"] * k) for n, k in ((3, 2), (1, 1), (5, 7))]
    wrapper = json.loads(wrappers.infer_wrapper(pages))
    assert "|" not in wrapper["regex"] and wrapper["regex"].count("++") >= 2 and wrapper["regex"].count("?+") == 0
    text, fitted = wrappers.extracted(page(9, "new", ["a", "b", "c"]), json.dumps(wrapper))
    assert fitted and text == "new\na\nb\nc"


@pytest.mark.parametrize(
    "page, text",
    [
        ('<body class="has-sidebar"><div class="content">yes<div class="ad-box">no</div></div></body>', "yes"),
        ('<section class="comments"><article><p>no</article></section><article class="post with-sidebar"><header><h1>T</h1></header><p>yes</article>', "T\nyes"),
        ('<article><div class="entry-header"><h1>T</h1></div><p>yes<article class="comment">no</article></article>', "T\nyes"),
        ('<div role="main">yes</div><div id="cookie_notice">no</div><form>no</form>', "yes"),
        ('<header>no</header><p>yes</p><p class="notice">no</p><div>too</div><footer>no', "yes\ntoo"),
        ('<div class="ad"><main>yes</main></div>', "yes"),
    ],
)
def test_what_is_main_text(page, text):
    assert wrappers.extracted(page, None)[0] == text


def test_broken_nesting_takes_linear_time():
    page = "<div>" * 30_000 + "<article><p>yes" + "</section>" * 30_000 + "<p>more"
    assert wrappers.extracted(page, None)[0] == "yes\nmore"


def test_pages_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", -1)
    monkeypatch.setattr(wrappers, "BROADCAST_PAGES", 0)
    df = spark.createDataFrame([(i, "http://h/", page(2, "t", ["p"])) for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in wrappers.extract_pages(df).collect()} == {"t\np"}


def linked(vectors, least=0.9):
    usable = {i: np.array(v, float) for i, v in vectors if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    pairs = {
        (i, j)
        for i, a in usable.items()
        for j, b in usable.items()
        if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= least
    }
    label = {i: i for i, _ in vectors}
    while any(label[i] < label[j] for i, j in pairs):
        for i, j in pairs:
            label[j] = min(label[i], label[j])
    return {i: (sum(a == i for a, _ in pairs), label[i]) for i, _ in vectors}


@pytest.mark.parametrize("rows", [2048, 8])
def test_vectors(spark, rows):
    r = np.random.default_rng(6)
    base = r.standard_normal((12, 16))
    vectors = [(i, list(map(float, base[i % 12] * (1 + i % 3) + 0.02 * r.standard_normal(16) * (i % 2)))) for i in range(80)]
    nan = float("nan")
    vectors += [(200, None), (201, []), (202, [0.0] * 16), (203, [nan] + [1.0] * 15), (204, [None] + [1.0] * 15), (205, [float("inf")] * 16)]
    vectors += [(206, vectors[3][1]), (207, vectors[3][1][:8]), (208, [1e-300] * 16), (209, [1e300] * 16)]
    df = spark.createDataFrame([(*v, 1) for v in vectors], "vec_id long, embedding array<double>, node int")
    found = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in vector_dedup.near_vectors(df, bucket_rows=rows).collect()}
    want = linked([v for v in vectors if v[0] not in (208, 209)])
    want[208], want[209] = (1, 208), (1, 208)
    assert found == {i: (n, c, c == i) for i, (n, c) in want.items()}


def test_vector_edges(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (None, [1.0, 0.0])]
    found = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((x.vec_id or 0, x.n_links, x.component_id or 0, x.kept) for x in found) == [(0, 0, 0, False), (1, 0, 1, True), (1, 1, 1, True), (1, 1, 1, True)]
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


SCHEMAS = {"cut": {"type": "object", "required": ["start"], "properties": {"start": {"type": "integer", "minimum": 0}}, "additionalProperties": False}}
CALLS = "session_id long, seq long, call_id string, tool string, arguments string, after array<string>, level string"
RESULTS = "session_id long, seq long, call_id string, content string"


def test_calls(spark):
    calls = [
        (1, 5, "b", "cut", '{"start": 1.0}', ["a"], ""),
        (1, 9, "a", "cut", '{"start":-1}', None, ""),  # logged after the call that needs it
        (1, 10, "c", "cut", '{"stop":1}', ["b", "zzz", None], ""),
        (1, 11, "c", "cut", '{"start":2}', None, ""),  # the id again
        (1, 12, "d", "other", "{}", ["e"], ""),
        (1, 13, "e", "cut", '{"start":1,"start":2}', ["d"], ""),  # a cycle
        (2, 1, None, None, None, None, ""),
        (None, 1, "a", "cut", '{"start":3}', None, ""),
        (3, 1, "t", "cut", '{"start":3}', ["u"], ""),
        (3, 1, "u", "cut", '{"start":3}', None, ""),  # the same place
        (3, 1, "u", "cut", '{"start":3}', None, ""),
    ]
    results = [(1, 6, "b", "é\n"), (1, 7, "b", None), (1, 8, "x", "lost"), (2, 2, None, "n"), (1, 3, "a", "r")]
    found = tool_links.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    at = {(r.session_id, r.call_id, r.seq, r.result_seq, r.status): r for r in found}
    assert len(found) == len(at) == 14
    assert {s: sum(r.status == s for r in found) for s in ("linked", "pending", "orphan", "repeated")} == {"linked": 3, "pending": 7, "orphan": 2, "repeated": 2}
    b, a = at[1, "b", 5, 6, "linked"], at[1, "a", 9, 3, "linked"]
    assert b.message == '{"arguments":{"start":1},"call_id":"b","name":"cut","result":"é\\n"}' and b.valid
    assert a.errors == ["$.start: minimum"] and (a.rank, a.level) < (b.rank, b.level)
    c = at[1, "c", 10, None, "pending"]
    assert c.dangling == 1 and c.errors == ["$.start: missing", "$.stop: unknown"] and c.rank >= b.rank
    d, e = at[1, "d", 12, None, "pending"], at[1, "e", 13, None, "pending"]
    assert d.cyclic and e.cyclic and d.errors == ["unknown tool"] and e.errors == ["$: no JSON"] and not b.cyclic
    t, u = at[3, "t", 1, None, "pending"], at[3, "u", 1, None, "pending"]
    assert (u.rank, u.level) < (t.rank, t.level)
    assert at[2, None, 1, None, "pending"].errors == ["$: no JSON"] and at[2, None, None, 2, "orphan"].valid is None
    none = spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)
    assert tool_links.link_calls(*none, SCHEMAS).collect() == []


def test_calls_in_any_order(spark):
    r = random.Random(7)
    ids = list(range(40))
    needs = {i: sorted(r.sample(range(i), min(i, r.randint(0, 2)))) for i in ids}
    seqs = {i: r.randint(0, 15) for i in ids}
    calls = [(1, seqs[i], str(i), "cut", "{}", [str(n) for n in needs[i]], "") for i in ids]
    empty = spark.createDataFrame([], RESULTS)
    found = tool_links.link_calls(spark.createDataFrame(calls, CALLS), empty, {}).collect()
    place = {r.call_id: k for k, r in enumerate(sorted(found, key=lambda r: (r.rank, r.level, r.seq, r.call_id)))}
    assert len(place) == 40 and all(place[str(n)] < place[str(i)] for i in ids for n in needs[i]) and not any(r.cyclic for r in found)


def test_json_rules():
    assert tool_links.canonical({"b": [1.0, 1.5, None], "a": "ü"}) == '{"a":"ü","b":[1,1.5,null]}'
    schema = {"type": ["array", "null"], "items": {"enum": [1, "x"]}}
    assert tool_links.violations([1, "x"], schema) == [] and tool_links.violations([2], schema) == ["$[0]: not in enum"]
    assert tool_links.violations(True, {"type": "integer"}) == ["$: not integer"]
    for bad in ("", "NaN", '{"a":1,"a":1}', "{", None, "[" * 100_000):
        assert tool_links.judged("t", bad, {"t": {}})[1] == ["$: no JSON"]


def test_surrogates(spark):
    rows = [
        (1, "Mr John Smith, +1 (555) 123-4567 or 555-123-4567; John.Smith@Mail4.example.com, john.smith@mail4.example.com."),
        (2, 'Frau Erika Müller 192.168.10.7### 4111 1111 1111 1111!! 4111111111111111 DE44 5001 0517 5407 3249 31; Mr Smith. token = "' + "0a" * 20 + '"'),
        (3, "Version 2.0 of 1234 things, 10% at 12:30, chapter 1.2.3. Mrs."),
        (4, None),
        (5, ""),
        (6, "Господин Иван Петров 078-05-1120"),
        (6, "Господин Иван Петров 078-05-1120"),
        (None, "é.55@mail4.example.com Frau Petra Smith"),
        (8, "x " * 20_000 + "555-123-4567"),
    ]
    df = spark.createDataFrame([(*r, "e") for r in rows], "file_id long, text string, entities string")
    found = surrogates.replace_entities(df, "key")
    out = {r.file_id: r for r in found.collect()}
    assert found.count() == len(rows)
    one, two, six = out[1].text, out[2].text, out[6].text
    m = re.fullmatch(r"Mr (\w+us) (\w{5}), \+1 \((\d{3})\) (\d{3}-\d{4}) or (\d{3})-(\d{3}-\d{4}); (\S+@\S+\.com), (\S+@\S+\.com)\.", one)
    assert m and m[3] == m[5] and m[4] == m[6] and m[7] == m[8] and m[2] != "Smith" and m[3] + m[4] != "555123-4567"
    m2 = re.fullmatch(r'Frau (\w+ia) (\w{6}) (\S+)### (\d{4}) (\d{4}) (\d{4}) (\d{4})!! (\d{16}) DE\d\d( \d{4}){4} \d\d; Mr (\w{5})\. token = "([0-9a-f]{40})"', two)
    assert m2 and "".join(m2.group(4, 5, 6, 7)) == m2[8] != "4111111111111111" and m2[10] == m[2] and m2[11] != "0a" * 20
    assert all(0 < int(x) < 256 for x in m2[3].split(".")) and m2[3] != "192.168.10.7"
    assert out[3].text == rows[2][1] and out[4].text is None and out[5].text == ""
    assert re.fullmatch(r"Господин [а-яА-Я]+ус [А-Я][а-я]{5} \d{3}-\d{2}-\d{4}", six) and "Петров" not in six
    assert out[None].text.endswith(m[2]) and out[8].text == "x " * 20_000 + one.split(" or ")[1][:12]
    assert {k: v for k, v in out[1].entities.items() if v} == {"person": 1, "phone": 2, "email": 2} and not any(out[4].entities.values())
    assert surrogates.replace_entities(df.limit(0), "key").collect() == []
    assert surrogates.replace_entities(df, "other").filter("file_id = 1").first().text != one
    with pytest.raises(ValueError):
        surrogates.replace_entities(df, "")


def test_surrogates_stay_distinct(spark):
    # Nearly all addresses of this form are taken, so first draws collide, with each other and with real ones.
    rows = [("address", f"{a}.{b}.1.1") for a in range(1, 8) for b in range(1, 8)]
    found = surrogates.distinct_surrogates(spark.createDataFrame(rows, "role string, canon string"), "k").collect()
    made = [r.surrogate for r in found]
    assert len(set(made)) == len(rows) and not set(made) & {c for _, c in rows}


def test_archives(spark, tmp_path):
    long = "payload é " * 200
    rows = [(i, f"http://x/{i}", long if i % 3 == 0 else f"{i} <html>" + "words and words " * i) for i in range(60)]
    rows += [(100, None, None), (101, "a b\r\nc", ""), (102, "u", "é" * 499), (103, "u", "é" * 499), (104, "u", "z" * 1000), (105, "u", "z" * 1000)]
    rows += [(None, "u", long), (59, "http://x/59", rows[59][2])]
    df = spark.createDataFrame([(*r, "t") for r in rows], "record_id long, uri string, payload string, record_type string")
    folder = f"file://{tmp_path}/w"
    listed = archives.write_archives(df, folder, archive_bytes=2000).collect()
    assert len(listed) > 4 and sum(r.records for r in listed) == len(rows)
    found = archives.read_archives(spark, folder).collect()
    last = {}
    for i, _, p in rows:
        if i is not None and len((p or "").encode()) >= 1000:
            last[p] = max(i, last.get(p, 0))
    want = []
    for i, _, p in rows:
        raw, of = (p or "").encode(), last.get(p) if i is not None else None
        revisit = of is not None and i < of
        want.append((i or 0, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", of if revisit else 0))
    assert sorted((r.record_id or 0, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or 0) for r in found) == sorted(want)
    assert {r.record_id: r.payload for r in found if r.record_type == "response" and r.record_id is not None} == {
        i: p or "" for i, _, p in rows if i is not None and not (p in last and i < last[p])
    }
    archive = (tmp_path / "w" / listed[0].path).read_bytes()
    assert archive[:4] == b"\x5d\x2a\x4d\x18"
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(archives.frames(archive[:-3]))
    empty = f"file://{tmp_path}/e"
    assert archives.write_archives(df.limit(0), empty).collect() == [] and archives.read_archives(spark, empty).collect() == []


def template_page(k, body=None):
    """An article between a greeting, a row of links and a small print that no tag or class marks."""
    body = body or [f"Article {k} says thing {i} of its own, at some length." for i in range(3)]
    return (
        "<html><body><div><p>Welcome to our site</p><p>All the news since 1999</p></div>"
        + f"<div><h1>Title {k}</h1>" + "".join(f"<p>{t}</p>" for t in body) + "</div><div><p>Write to us any time</p></div></body></html>"
    )


def test_text_that_a_host_repeats_is_template(spark):
    """The wrapper decides: the same pages read by their own tags give other text."""
    pages = [template_page(k) for k in range(12)]
    wrapper = wrappers.infer_wrapper(pages)
    text, fitted = wrappers.extracted(template_page(77), wrapper)
    alone, _ = wrappers.extracted(template_page(77), None)
    assert fitted and text == "\n".join(["Title 77", *(f"Article 77 says thing {i} of its own, at some length." for i in range(3))])
    assert alone == "\n".join(["Welcome to our site", "All the news since 1999", text, "Write to us any time"])
    df = spark.createDataFrame([(k, f"http://h.example/{k}", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in wrappers.extract_pages(df).collect()}
    assert all(found[k].startswith(f"Title {k}\n") and "Welcome" not in found[k] and "Write" not in found[k] for k in found)


def test_wrappers_come_from_all_pages(spark, monkeypatch):
    """One page in forty has a paragraph more, and a line that half of a host's pages share is counted over all of them."""
    monkeypatch.setattr(wrappers, "GROUP_FORMS", 2)
    rare = "<html><body><div><p>Welcome to our site</p></div><div><h1>Title {0}</h1>{1}<p>Text {0} at some length.</p></div>{2}</body></html>"
    extra = [f"<{tag}>Aside {k}</{tag}>" for k, tag in enumerate(("blockquote", "pre", "figure", "address", "dl"))]
    pages = [rare.format(k, extra[k // 40] if k % 40 == 7 else "", "<div>Our partners</div>" if k % 3 else "") for k in range(200)]
    df = spark.createDataFrame([(k, "http://h.example/", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    found = {r.page_id: r for r in wrappers.extract_pages(df).collect()}
    assert all(r.fitted for r in found.values())
    for k, r in found.items():
        assert r.text == "\n".join([f"Title {k}", *([f"Aside {k // 40}"] if k % 40 == 7 else []), f"Text {k} at some length."])


def test_copies_of_a_page_are_no_template():
    same = ["The very same article on every page of this host."] * 3
    pages = [template_page(k, same) for k in range(12)]
    text, fitted = wrappers.extracted(pages[0], wrappers.infer_wrapper(pages))
    assert fitted and same[0] in text
    assert wrappers.template_slots([{"s1": ["a"], "s2": [f"b{k}"]} for k in range(3)]) == set()


@pytest.mark.parametrize(
    "page, text",
    [
        ('<p>yes <span class="ad">Buy now</span> more</p><amp-ad>ADVERT</amp-ad><span hidden>secret</span><ins class="advert">Sale</ins>', "yes more"),
        ('<article><div class="notice-period"><p>real text</p></div><div class="post-share-price"><p>too</p></div></article>', "real text\ntoo"),
        ('<div class="cookie-banner">c</div><div class="site-footer">f</div><div class="comments-area">x</div><p>stays</p>', "stays"),
        ('<p>a <ins class="ad">never closed</p><p>b</p>', "a\nb"),
        ('<p>a <ins class="ad"><div>x</div>y</ins> b</p><p>c</p>', "a b\nc"),
        ('<p>a <span class="ad">x <span>y</span> z</span>b <img class="ad"> c <b>d</b></p>', "a b c d"),
    ],
)
def test_inline_elements_and_whole_names(page, text):
    assert wrappers.extracted(page, None)[0] == text


def test_long_pages_have_wrappers(monkeypatch):
    """Thousands of tags in cycles too long for a repeated group, and a page that has one element more."""
    order = "div section pre blockquote table ul dl figure address details".split() * 250

    def page(k, more=""):
        inner = "".join(f"<{t}>text {k} {i}</{t}>" for i, t in enumerate(order))
        return f"<html><body><article>{inner}{more}</article></body></html>"

    pages = [page(0), page(1), page(2, "<hr>last")]
    for cells in (1 << 20, 0):
        monkeypatch.setattr(wrappers, "TABLE_CELLS", cells)
        wrapper = wrappers.infer_wrapper(pages)
        assert all(wrappers.extracted(p, wrapper)[1] for p in pages)


def test_common_items(monkeypatch):
    r = random.Random(3)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 12))] for _ in range(2))
        lengths = []
        for cells in (1 << 20, 0):
            monkeypatch.setattr(wrappers, "TABLE_CELLS", cells)
            pairs = wrappers.common_items(a, b)
            assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
            lengths.append(len(pairs))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        assert lengths[0] == table[-1][-1] >= lengths[1]


def test_calls_without_a_place(spark):
    calls = [(1, None, "a", None, "{}", None, ""), (1, 4, "b", "cut", '{"start":1}', ["a"], ""), (1, None, "c", "cut", '{"start":1}', ["b"], ""),
             (1, 2, "d", "cut", '{"start":1}', ["e"], ""), (1, 2, "e", "cut", '{"start":1}', ["d"], ""), (1, 2, "f", "cut", "{}", ["d", "g"], "")]
    none = spark.createDataFrame([], RESULTS)
    at = {r.call_id: r for r in tool_links.link_calls(spark.createDataFrame(calls, CALLS), none, SCHEMAS).collect()}
    assert at["a"].status == "pending" and at["a"].errors == ["unknown tool"] and at["a"].rank is None
    assert at["b"].dangling == 0 and (at["b"].rank, at["c"].rank) == (4, 4) and at["c"].level == 1
    assert all(at[c].cyclic and at[c].level is None for c in "def") and at["f"].dangling == 1


def test_pairs_near_the_threshold_are_found(spark):
    """Recall at a cosine just above the bound, which the tables must find in nine of ten cases."""
    g = np.random.default_rng(5)
    rows, dimension, pairs = [], 64, 600
    for k in range(pairs):
        a, b = g.standard_normal((2, dimension))
        a /= np.linalg.norm(a)
        b -= (a @ b) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist()), (2 * k + 1, (0.901 * a + np.sqrt(1 - 0.901**2) * b).tolist())]
    found = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    linked = found.filter("vec_id % 2 = 0 AND n_links > 0").count()
    assert 0.9 * pairs <= linked <= pairs

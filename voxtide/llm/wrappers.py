"""Main text of web pages by wrappers: union-free regular expressions inferred from all pages of one host.

The library has no web pages of its own, so this operator is general: a page has an id, a URL and HTML.
"""

from __future__ import annotations

import html
import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator, Sequence
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxtide.llm.batches import by_bytes
from voxtide.session import cut_lineage, shared_dir

# Forms of a host that one task aligns; a host with more has them aligned group by group, and then the groups' wrappers.
GROUP_FORMS = 256
# HTML that is read into memory at once.
BATCH_BYTES = 4 << 20
# Longest repeated group of tags, and the share of items that a page has in common with a wrapper of its kind.
LONGEST_GROUP = 12
# Cells of an alignment table; longer pages are aligned by their longest common stretches.
TABLE_CELLS = 1 << 20
LEAST_COMMON = 0.6
# Pages that must hold a slot before it is judged by its texts, and the share of them that a template's text is on.
LEAST_PAGES, TEMPLATE_SHARE = 4, 0.6
# What is sent to every task: bytes of wrappers, and hosts' commonest forms.
BROADCAST_BYTES, BROADCAST_PAGES = 8 << 20, 200_000

# Fixed values of HTML: elements without content of their own, elements that make blocks, those whose end tags may be left out.
RAW = "script style textarea noscript template svg iframe object title select"
BLOCKS = (
    "html head body article main section nav aside header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead "
    "tbody tfoot tr td th form fieldset legend blockquote pre figure figcaption address details summary dialog menu hr center button label"
)
VOID = {*"area base br col embed img input link meta param source track wbr".split()}
OPEN_ENDED = {*"p li dt dd tr td th thead tbody tfoot caption hr".split()}
# What is no part of an article: elements, roles, and words of class or id.
OUTSIDE = {*"head nav footer aside form button dialog menu fieldset label".split()}
ROLES = {*"navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split()}
WORDS = {
    *"ad ads adv advert advertisement adverts advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice".split(),
    *"notification alert sidebar menu nav navbar navigation breadcrumb breadcrumbs header footer masthead comment comments reply".split(),
    *"replies disqus share sharing social related recommended recommendations newsletter subscribe subscription signup login popup".split(),
    *"modal overlay widget toolbar pagination pager skip hidden".split(),
}
CONTENT = {*"article content post entry story articlebody maincontent".split()}
# A class that speaks of something else's presence; and what an article or main element is when it is not the main text.
ASIDE, NOT_MAIN = {*"with has no without".split()}, {*"comment comments reply replies related recommended promo sponsored ad advert teaser".split()}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    rf"|<({RAW.replace(' ', '|')})\b[^>]*+>.*?(?:</\1\s*+[^>]*+>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)"
    r"""|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>"']|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""",
    re.DOTALL | re.IGNORECASE,
)
# Parts of a compound class that say where or what shape it is, and nothing else.
NEUTRAL = {
    *"box container wrap wrapper list item items block section area bar top bottom left right inner outer main site page content body".split(),
    *"global primary secondary links buttons button icons posts articles form widgets group panel slot unit card row col column text".split(),
    *"title js is the desktop mobile sticky fixed reader readers user users".split(),
}
_ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)\b(?:\s*+=\s*+("[^"]*"|'[^']*'|[^\s>]+))?""", re.IGNORECASE)
_BLOCK = {*BLOCKS.split()}


@lru_cache(maxsize=65_536)
def _key(slash: str, name: str, attributes: str) -> str:
    """A tag as the wrapper knows it: its name, and what it says of its role (x: outside, m: main text)."""
    if slash:
        return "/" + name
    found = {k.lower(): v.strip("\"'").lower() for k, v in _ATTRIBUTE.findall(attributes)}
    words, says = set(), set()
    for token in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = {p for p in re.split(r"[^a-z]+", token) if p}
        words |= parts
        # A name counts as a whole: a notice box is a notice, a notice period is a text.
        if not parts & ASIDE and parts <= WORDS | NEUTRAL | CONTENT:
            # The header of an entry is not that of a page.
            says |= (parts & WORDS) - ({"header"} if parts & CONTENT else set())
    main = name in ("article", "main") or found.get("role") in ("main", "article") or found.get("itemprop") == "articlebody"
    main = main and not words & NOT_MAIN
    said = says & NOT_MAIN if name in ("article", "main") else says if name not in ("html", "body") else set()
    outside = name in OUTSIDE or found.get("role") in ROLES or said or "hidden" in found or found.get("aria-hidden") == "true"
    soft = not main and not outside and (words & CONTENT)
    return name + (".m" if main else ".x" if outside else ".c" if soft else "")


@lru_cache(maxsize=65_536)
def _inline_outside(name: str, attributes: str) -> bool:
    """Whether an element that makes no block is no part of the text: by its attributes, or a name of its own such as that
    of an advert."""
    return _key("", name, attributes).endswith(".x") or ("-" in name and bool(set(name.split("-")) & WORDS))


def page_tokens(page: str) -> tuple[list[str], list[str]]:
    """Block tags of a page in order, and the raw text that follows each; inline tags and raw elements are left out, and so
    are inline elements that are no part of the text (adverts, hidden ones) with what they hold."""
    keys, texts, parts, at = ["^"], [], [], 0
    # An inline element that is no part of the text, with the depth of its own name and of blocks inside it.
    skipped, depth, inside = None, 0, 0
    for m in _TOKEN.finditer(page):
        if skipped is None:
            parts.append(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if skipped is not None:
            if name == skipped:
                depth += -1 if m[2] else 1
                if not depth:
                    skipped = None
                    parts.append(" ")
                continue
            if name not in _BLOCK or (name in OPEN_ENDED and inside):
                continue
            inside += -1 if m[2] else name not in OPEN_ENDED
            if inside >= 0 and not (name in OPEN_ENDED and not inside):
                continue
            # Never closed: it ends with the block that it stands in.
            skipped = None
        if name and name not in _BLOCK and name not in VOID and not m[2] and not m[4].rstrip().endswith("/") and _inline_outside(name, m[4]):
            skipped, depth, inside = name, 1, 0
        elif name in _BLOCK:
            if not (m[2] and name in OPEN_ENDED):
                texts.append("".join(parts))
                keys.append(_key(m[2], name, m[4]))
                parts = []
            else:
                parts.append(" ")
        elif name == "br" or m[1]:
            parts.append(" ")
    texts.append("".join([*parts, page[at:]]))
    return keys, texts


def main_slots(keys: Sequence[str]) -> list[bool]:
    """Which of the texts after the tags belong to the main text: inside what is marked as such, where anything is,
    and outside of everything that is marked as something else. Main text inside something else, as an article in the
    comments, counts only where there is no other."""
    for mark in ("m", "c"):
        if any(k.endswith("." + mark) for k in keys):
            for free in (True, False):
                inside = _inside(keys, mark, free)
                if any(i is not None for i in inside):
                    return [bool(i) for i in inside]
    return [bool(i) for i in _inside(keys, "", False)]


def _inside(keys: Sequence[str], main: str, free: bool) -> list[bool | None]:
    """For each tag: None outside of elements marked ``main``, else whether nothing above it is marked as something else.

    With ``free``, elements marked ``main`` inside something else do not count. Without a mark the whole page counts.
    """
    # Of each open element: its name, whether main text has begun, whether something else has since, and at all.
    stack, open_names = [("", not main, False, False)], Counter()
    out: list[bool | None] = []
    for key in keys:
        name, _, mark = key.partition(".")
        once = False
        if name.startswith("/"):
            while open_names[name[1:]]:
                last = stack.pop()[0]
                open_names[last] -= 1
                if last == name[1:]:
                    break
        elif name in OPEN_ENDED:
            once = mark == "x"
        elif name != "^":
            _, begun, blocked, other = stack[-1]
            if begun:
                # The header of an article is its own; a page's is not.
                blocked = blocked or mark == "x" or (name == "header" and not main)
            elif mark == main and not (free and other):
                begun = True
            stack.append((name, begun, blocked, other or mark == "x"))
            open_names[name] += 1
        _, begun, blocked, _ = stack[-1]
        out.append(not blocked and not once if begun else None)
    return out


# A wrapper is a list of (item, optional); an item is a tag or a tuple of tags that occurs once or more.
Item = str | tuple


def folded(items: list[Item]) -> list[Item]:
    """Adjacent equal groups become one repeated group, shortest first."""
    for size in range(1, LONGEST_GROUP + 1):
        out, at = [], 0
        while at < len(items):
            group = items[at : at + size]
            end = at + size
            while len(group) == size and items[end : end + size] == group:
                end += size
            if end > at + size:
                flat = tuple(x for i in group for x in (i if isinstance(i, tuple) else (i,)))
                out.append(group[0] if size == 1 and isinstance(group[0], tuple) else flat)
                at = end
            else:
                out.append(items[at])
                at += 1
        items = out
    return items


def with_groups(items: list[Item], groups: list[tuple]) -> list[Item]:
    """Single occurrences of known repeated groups as such."""
    for group in groups:
        out, at, size = [], 0, len(group)
        while at < len(items):
            if tuple(items[at : at + size]) == group:
                out.append(group)
                at += size
            else:
                out.append(items[at])
                at += 1
        items = out
    return folded(items)


def aligned(wrapper: list[tuple[Item, bool]], page: list[Item]) -> list[tuple[Item, bool]]:
    """The wrapper that also fits the page: what either side lacks becomes optional (longest common subsequence).
    A page with less than ``LEAST_COMMON`` in common is of another kind and changes nothing."""
    return merged(wrapper, [(i, False) for i in page], LEAST_COMMON)


def _regrouped(wrapper: list[tuple[Item, bool]], groups: list[tuple]) -> list[tuple[Item, bool]]:
    mine = [i for i, _ in wrapper]
    known = with_groups(mine, groups)
    if known == mine:
        return wrapper
    optional = {i for i, o in wrapper if o}
    return [(i, i in optional or (isinstance(i, tuple) and optional.issuperset(i))) for i in known]


def merged(wrapper: list[tuple[Item, bool]], other: list[tuple[Item, bool]], common: float) -> list[tuple[Item, bool]]:
    """The wrapper that fits what either of the two fits; one that has less than the share ``common`` of its items in
    common with the other stays as it is."""
    groups = sorted({i for i, _ in (*wrapper, *other) if isinstance(i, tuple)}, key=lambda g: (-len(g), g))
    wrapper, other = _regrouped(wrapper, groups), _regrouped(other, groups)
    mine, page = [i for i, _ in wrapper], [i for i, _ in other]
    rows, cols = len(mine), len(page)
    least = common * max(rows, cols)
    if (Counter(mine) & Counter(page)).total() < least:
        return wrapper
    pairs = common_items(mine, page)
    if len(pairs) < least:
        return wrapper
    out, i, j = [], 0, 0
    for a, b in [*pairs, (rows, cols)]:
        out += [(item, True) for item in (*mine[i:a], *page[j:b])]
        out += [(item, o or other[b][1]) for item, o in wrapper[a : a + 1]]
        i, j = a + 1, b + 1
    return out


def common_items(a: list[Item], b: list[Item]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence. What begins and ends alike is paired off first; of what is then still
    long, the longest common stretches are, in memory that grows with the lengths and not with their product."""
    start, end = 0, 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    x, y = a[start : len(a) - end], b[start : len(b) - end]
    if len(x) * len(y) > TABLE_CELLS:
        blocks = SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks()
        inner = [(m.a + k, m.b + k) for m in blocks for k in range(m.size)]
    else:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        inner, i, j = [], 0, 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                inner.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    ends = [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]
    return [*((k, k) for k in range(start)), *((start + i, start + j) for i, j in inner), *ends]


def infer_wrapper(pages: Sequence[str]) -> str:
    """The wrapper of a few pages at hand as JSON: characters of the tags, the expression over them, main text slots.

    It begins with the commonest form of page. ``regex`` has a named group for each tag, which stands for the text
    slot that follows it. A slot can be main text where the elements around it say so in most of the pages that the
    wrapper fits; of those slots, the ones with the same texts on most pages are template (``template_slots``).
    """
    read = [page_tokens(page) for page in pages]
    tags = [keys for keys, _ in read]
    forms = Counter(tuple(folded(keys)) for keys in tags)
    wrapper: list[tuple[Item, bool]] = []
    for form, _ in sorted(forms.items(), key=lambda f: (-f[1], len(f[0]), str(f[0]))):
        wrapper = aligned(wrapper, list(form)) if wrapper else [(i, False) for i in form]
    chars, expression, n = expression_of(wrapper)
    pattern, votes = regex.compile(expression), Counter()
    held: list[dict[str, list[str]]] = []
    for keys, texts in read:
        fit = pattern.fullmatch("".join(chars.get(k, "?") for k in keys))
        inside = main_slots(keys)
        held.append({})
        for k in range(n if fit else 0):
            starts = [start for start, _ in fit.spans(f"s{k}")]
            votes[f"s{k}"] += sum(1 if inside[start] else -1 for start in starts)
            held[-1][f"s{k}"] = [t for t in (block_text(texts[start]) for start in starts) if t]
    main = [s for s in sorted(votes) if votes[s] > 0]
    fixed = template_slots([{s: page[s] for s in main if page.get(s)} for page in held])
    return json.dumps({"tags": chars, "regex": expression, "main": [s for s in main if s not in fixed], "fixed": sorted(fixed)}, ensure_ascii=False)


def expression_of(wrapper: list[tuple[Item, bool]]) -> tuple[dict[str, str], str, int]:
    """Characters of a wrapper's tags, the expression over them, and the number of its slots."""
    flat = [t for i, _ in wrapper for t in (i if isinstance(i, tuple) else (i,))]
    chars = {k: chr(0xE000 + n) for n, k in enumerate(dict.fromkeys(flat))}
    parts, n = [], 0
    for item, optional in wrapper:
        group = item if isinstance(item, tuple) else (item,)
        body = "".join(f"(?P<s{n + k}>{chars[t]})" for k, t in enumerate(group))
        n += len(group)
        # Possessive: a page is read once, without going back.
        parts.append(f"(?:{body})" + ("*+" if optional else "++") if isinstance(item, tuple) else body + ("?+" if optional else ""))
    return chars, "".join(parts), n


def template_slots(pages: Sequence[dict[str, list[str]]]) -> set[str]:
    """Slots whose texts belong to the host and not to a page: with ``LEAST_PAGES`` pages or more, most of the text in the
    slot is on ``TEMPLATE_SHARE`` of them. ``pages`` have the texts of each slot.

    Pages that are copies of each other have all texts in common, which says nothing: slots are template only while the
    varying ones hold more text than they do.
    """
    found, sizes = set(), Counter()
    for slot in sorted({s for page in pages for s in page}):
        holders = [page[slot] for page in pages if slot in page]
        on = Counter(text for texts in holders for text in set(texts))
        total = sum(len(t) for texts in holders for t in texts)
        common = sum(len(t) for texts in holders for t in texts if on[t] >= TEMPLATE_SHARE * len(holders))
        sizes[slot] = total
        if len(holders) >= LEAST_PAGES and 2 * common > total:
            found.add(slot)
    fixed = sum(sizes[s] for s in found)
    return found if sum(sizes.values()) - fixed > fixed else set()


@lru_cache(maxsize=2_048)
def _compiled(wrapper: str) -> tuple[dict[str, str], regex.Pattern, list[str]]:
    made = json.loads(wrapper)
    return made["tags"], regex.compile(made["regex"]), made["main"]


def block_text(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def extracted(page: str, wrapper: str | None) -> tuple[str, bool]:
    """Main text of a page, and whether its host's wrapper fits; else the page's own tags tell."""
    keys, texts = page_tokens(page)
    if wrapper is not None:
        tags, pattern, main = _compiled(wrapper)
        line = "".join(tags.get(k, "") for k in keys)
        fit = pattern.fullmatch(line)
        if fit:
            slots = sorted(start for s in main for start, _ in fit.spans(s))
            return "\n".join(filter(None, (block_text(texts[i]) for i in slots))), True
    inside = main_slots(keys)
    return "\n".join(filter(None, (block_text(t) for t, i in zip(texts, inside) if i))), False


def host_of(url: Column) -> Column:
    """Host of a URL in lower case, without user and port; empty for null and for what has none."""
    place = F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return place


def page_records(pages: DataFrame) -> DataFrame:
    """Every distinct page of a host once, without its text: ``host, digest, tags, inside`` (for each tag, whether what
    follows it can be main text), ``sums, sizes`` (hash and characters of the text there; 0 without text)."""
    schema = "host string, digest string, tags string, inside string, sums array<bigint>, sizes array<int>"
    names = ["host", "digest", "tags", "inside", "sums", "sizes"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, BATCH_BYTES):
            out: list[list] = [[] for _ in range(4)]
            for page in batch.column(2).to_pylist():
                keys, texts = page_tokens(page)
                blocks = [block_text(t) for t in texts]
                out[0].append("\n".join(keys))
                out[1].append("".join("1" if i else "0" for i in main_slots(keys)))
                out[2].append([_text_sum(t) if t else 0 for t in blocks])
                out[3].append([len(t) for t in blocks])
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v, k) for v, k in zip(out, kinds))], names)

    rows = pages.filter("html IS NOT NULL").select(host_of(F.col("url")).alias("host"), F.md5("html").alias("digest"), "html")
    return rows.mapInArrow(read, schema).dropDuplicates(["host", "digest"])


def _text_sum(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _items(wrapper: str) -> list[tuple[Item, bool]]:
    return [(tuple(i) if isinstance(i, list) else i, o) for i, o in json.loads(wrapper)]


def _rank(n: int, items: list[tuple[Item, bool]]) -> tuple[int, int, str]:
    """Commonest first, then the shorter one."""
    return -n, len(items), str(tuple(i for i, _ in items))


def page_forms(records: DataFrame) -> DataFrame:
    """``host, wrapper, n``: every form that pages of a host have, as a wrapper without options, and how many have it."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [json.dumps([[i, False] for i in folded(tags.split("\n"))]) for tags in batch["tags"]]
            yield pd.DataFrame({"host": batch["host"], "wrapper": forms, "n": batch["n"]})

    streams = records.groupBy("host", "tags").agg(F.count(F.lit(1)).alias("n"))
    return streams.mapInPandas(fold, "host string, wrapper string, n bigint").groupBy("host", "wrapper").agg(F.sum("n").alias("n"))


def aligned_forms(forms: DataFrame) -> DataFrame:
    """``host, wrapper`` of every host from all its forms, ``GROUP_FORMS`` of them to a task.

    Every group begins with the host's commonest form, so that all of them are of its kind and their wrappers can be
    merged in the same way, until one is left of each host.
    """
    level, first = cut_lineage(forms), True
    place = F.struct((-F.col("n")).alias("m"), F.length("wrapper").alias("l"), "wrapper")
    seeds = cut_lineage(level.groupBy("host").agg(F.min(place)["wrapper"].alias("seed"), F.count(F.lit(1)).alias("_all")))

    def merge(start: bool):
        def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            rows = sorted(((_rank(n, items), items) for n, items in zip(group["n"], map(_items, group["wrapper"]))), key=lambda r: r[0])
            seed = _items(group["seed"].iloc[0]) if start else rows[0][1]
            wrapper = seed
            for at, (_, items) in enumerate(rows):
                if (items != seed) if start else at:
                    wrapper = merged(wrapper, items, LEAST_COMMON if start else 0.0)
            return pd.DataFrame({"host": [key[0]], "wrapper": [json.dumps(wrapper)], "n": [int(group["n"].sum())]})

        return run

    while True:
        hosts = seeds if first else level.groupBy("host").agg(F.count(F.lit(1)).alias("_all")).withColumn("seed", F.lit(None).cast("string"))
        if not first and level.count() == hosts.count():
            return level.select("host", "wrapper")
        # Rows of one host, so many that they are dealt to groups, must not be brought together by this join.
        hosts = F.broadcast(hosts) if seeds.count() <= BROADCAST_PAGES else hosts
        dealt = level.join(hosts, "host").withColumn("_g", F.pmod(F.xxhash64("wrapper"), F.ceil(F.col("_all") / GROUP_FORMS)))
        level = cut_lineage(dealt.groupBy("host", "_g").applyInPandas(merge(first), "host string, wrapper string, n bigint"))
        first = False


@lru_cache(maxsize=2_048)
def _matcher(wrapper: str) -> tuple[dict[str, str], regex.Pattern, int]:
    tags, expression, n = expression_of(_items(wrapper))
    return tags, regex.compile(expression), n


def slot_figures(records: DataFrame, found: DataFrame) -> DataFrame:
    """Slots over all pages that fit their host's wrapper: ``host, slot, votes`` (pages' tags for and against main text),
    ``holders`` (pages with text there), ``total`` (characters), ``common`` (those of texts that ``TEMPLATE_SHARE`` of the holders
    have)."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[tuple, list[int]] = {}
            for host, keys, inside, marks, sizes, wrapper in zip(*(c.to_pylist() for c in batch.columns)):
                tags, pattern, n = _matcher(wrapper)
                fit = pattern.fullmatch("".join(tags.get(k, "?") for k in keys.split("\n")))
                for slot in range(n if fit else 0):
                    starts = fit.starts(f"s{slot}")
                    if not starts:
                        continue
                    held: Counter = Counter()
                    for at in starts:
                        if sizes[at]:
                            held[marks[at]] += sizes[at]
                    figures = sums.setdefault((host, slot, None), [0, 0])
                    figures[0] += sum(1 if inside[at] == "1" else -1 for at in starts)
                    figures[1] += bool(held)
                    for mark, size in held.items():
                        figures = sums.setdefault((host, slot, mark), [0, 0])
                        figures[0] += 1
                        figures[1] += size
            columns = [[k[i] for k in sums] for i in range(3)] + [[v[i] for v in sums.values()] for i in range(2)]
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "slot", "mark", "a", "b"])

    rows = records.join(found, "host").select("host", "tags", "inside", "sums", "sizes", "wrapper")
    rows = rows.mapInArrow(measure, "host string, slot int, mark bigint, a bigint, b bigint")
    rows = cut_lineage(rows.groupBy("host", "slot", "mark").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    slots = rows.filter("mark IS NULL").select("host", "slot", F.col("a").alias("votes"), F.col("b").alias("holders"))
    # A hot slot's texts are then summed where they lie.
    holders = slots.select("host", "slot", "holders")
    holders = F.broadcast(holders) if holders.count() <= BROADCAST_PAGES else holders
    texts = rows.filter("mark IS NOT NULL").join(holders, ["host", "slot"])
    shared = F.when(F.col("a") >= TEMPLATE_SHARE * F.col("holders"), F.col("b")).otherwise(0)
    texts = texts.groupBy("host", "slot").agg(F.sum("b").alias("total"), F.sum(shared).alias("common"))
    return slots.join(texts, ["host", "slot"], "left").na.fill(0, ["total", "common"])


def _small(found: DataFrame) -> DataFrame:
    """Wrappers go to every task only while they are few bytes; else a join that may split a host's pages brings them."""
    size = found.agg(F.sum(F.octet_length("wrapper") + F.octet_length("host"))).first()[0] or 0
    return F.broadcast(found) if size <= BROADCAST_BYTES else found


def host_wrappers(pages: DataFrame) -> DataFrame:
    """``host, wrapper`` of every host, from all its distinct pages.

    Pages are read once into tags and hashes of their texts. A host's forms are counted and aligned; what its slots hold is summed over
    all pages that fit, and rules as in ``template_slots`` tell main text from template by these sums.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/page-tags-{uuid.uuid4().hex}"
    page_records(pages).write.parquet(folder)
    records = spark.read.parquet(folder)
    found = aligned_forms(page_forms(records))
    slots = slot_figures(records, _small(found)).filter("votes > 0")
    template = (F.col("holders") >= LEAST_PAGES) & (2 * F.col("common") > F.col("total"))
    slots = slots.withColumn("template", template)
    hosts = slots.groupBy("host").agg(
        F.collect_list("slot").alias("main"),
        F.collect_list(F.when(F.col("template"), F.col("slot"))).alias("fixed"),
        F.sum("total").alias("_all"),
        F.sum(F.when(F.col("template"), F.col("total")).otherwise(0)).alias("_fixed"),
    )
    # Pages that are variants of each other: what they share is no template.
    hosts = hosts.select("host", "main", F.when(F.col("_all") > 2 * F.col("_fixed"), F.col("fixed")).alias("fixed"))

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for wrapper, main, fixed in zip(batch["wrapper"], batch["main"], batch["fixed"]):
                chars, expression, _ = expression_of(_items(wrapper))
                main, fixed = ([] if v is None else sorted(int(s) for s in v) for v in (main, fixed))
                parts = {"main": [f"s{s}" for s in main if s not in fixed], "fixed": [f"s{s}" for s in fixed]}
                out.append(json.dumps({"tags": chars, "regex": expression, **parts}, ensure_ascii=False))
            yield pd.DataFrame({"host": batch["host"], "wrapper": out})

    return found.join(hosts, "host", "left").mapInPandas(made, "host string, wrapper string")


def extract_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, host, text, fitted``: the main text of every whole page.

    Wrappers are inferred per host by aligning the tag streams of all its pages: repeated neighbours become repeated groups,
    what some pages lack becomes optional, and the text after each tag is a slot. A slot is main text if the
    elements around it allow it and its texts vary from page to page: text that the host's pages share is template,
    however it is marked. A page that its host's wrapper does not fit is read by its own tags.

    Text has character references decoded and white space within a block made one space; blocks are joined by a
    line feed. Null or empty HTML, and pages without main text, give the empty string. A null URL, or one without
    host, counts as the host ``''``; copies of a page shape its wrapper once; repeated rows
    return one by one. Further columns are ignored; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    found = _small(cut_lineage(host_wrappers(rows))).withColumnRenamed("host", "_h")
    placed = rows.withColumn("host", host_of(F.col("url")))
    joined = placed.join(found, placed["host"] == found["_h"], "left").drop("_h")
    names = ["page_id", "url", "host"]
    schema = ", ".join([f"page_id {rows.schema['page_id'].dataType.simpleString()}", f"url {rows.schema['url'].dataType.simpleString()}", "host string", "text string", "fitted boolean"])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [extracted(p or "", w) for p, w in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array([t for t, _ in pairs], pa.string()), pa.array([f for _, f in pairs], pa.bool_())], [*names, "text", "fitted"]
            )

    return joined.mapInArrow(extract, schema)

"""Main text of web pages: markup zones, and repeated runs found by suffix arrays over the streams of each host.

A tolerant scanner cuts a page into blocks with zones. Blocks inside menus, headers, footers, sidebars, notices,
adverts, forms, comments and the like (by element, role, or a class or id that says nothing else) are never text. Blocks inside an
``article`` or ``main`` element are main text and stay whole, as the contract has it, even where other pages repeat them; those of them whose class or
id only hints at something else (``SUSPECTS``) are asked about. On pages without such an element all other blocks are asked about.

The token streams of a host's pages are concatenated and their suffixes ranked by doubling. Runs that pages of other
content share are boilerplate: any ``LONG_RUN`` tokens, and whole blocks, as many in a row as make ``RUN_TOKENS`` tokens. A block that is
asked about loses the tokens so covered and keeps its unique runs; shorter phrases inside a block stay. Pages that have
``COPY`` of their content in common are copies: what only they have stays. For this the pages with the least and the
greatest key of those that have a run are looked at.

Hosts of up to ``GROUP_CHARS`` characters are ranked in one group, several small ones together. Pages of a larger host are dealt to
several groups, each with its suffix array; if the host has anything to ask, its groups exchange hashes of their distinct runs with the two least and
the two greatest keys of the pages that have them. These are all that a decision needs, so the texts are those that one group would give. Of a page with anything to
ask all runs of its content are answered, as copies are told by all of it. Hashes have 64 bits, keys of pages (number of tokens, uncapped, and hash of the content) too.

Null or empty html gives the empty text. A null url is a host of its own kind. Repeated page ids are
pages of their own. A very long page makes its host large. Unclosed elements, stray end tags and cut-off markup are read as browsers do, roughly. An empty table gives an
empty table; of other columns only those asked for pass through, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import html as entities
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kbspark.llm.common import batch_rows, offsets_of, slices, written

RUN_TOKENS, LONG_RUN = 5, 16
#: Characters of pages in a group of a host.
GROUP_CHARS = 2_000_000
#: Characters of pages whose runs make about one bucket of the exchange, and the least number of buckets.
BUCKET_CHARS, LEAST_BUCKETS = 64_000_000, 8
#: Base of the hashes of runs.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Share of its content that a page and its copy have in common.
COPY = 0.9
#: Bits of a page's key below its number of tokens; pages of ``LARGE`` tokens and more have keys with more room for the number.
SIZE_BITS, LARGE, LARGE_BITS = 44, 1 << 18, 31

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|</?[a-zA-Z][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes"}
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in RAW}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
OUT = set("nav aside footer form head button select svg canvas object audio video map dialog menu fieldset search datalist label math".split())
ROLES_OUT = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar tooltip status".split())
#: Words of class and id that mark what is no main text.
WORDS_OUT = set(
    "nav navbar navigation menu menus ad ads adv advert adverts advertisement advertisements advertising banner banners sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr notice notices alert popup modal overlay sidebar aside share sharing social comment comments commentlist reply replies respond disqus discussion footer foot masthead breadcrumb breadcrumbs pagination pager newsletter subscribe subscription signup login toolbar skip hidden outbrain taboola".split()
)
#: Words that a class or id of that kind may have besides: what it is made of, and where it stands.
PLAIN = set(
    "bar bars box boxes block blocks button buttons link links list lists item items icon icons label title text body inner outer wrapper wrap container content section area region zone panel unit group row col column slot main site page post article top bottom left right center primary secondary global local mobile desktop sticky fixed social media js ui is the my l m s".split()
)
#: Words that turn it round: the element is about the lack, the number or the presence of such a thing elsewhere.
TURNED = set("no not non without has have with in on count counts free off disabled enabled hide hides show shows closed open".split())
#: Words of comments by readers, which may be articles or sections of their own.
COMMENTS = set("comment comments commentlist reply replies respond response responses disqus discussion".split())
#: Words that only hint at it: the streams of the host decide.
SUSPECTS = set("widget widgets related recommended recommendations copyright disclaimer byline metadata tags tagcloud rail teaser teasers".split())
#: Elements that end when one of the given elements opens.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
EXCLUDED, UNDECIDED, MAIN, SUSPECT = 0, 1, 2, 3
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that end tags of phrases do not reach beyond.
WALLS = {"article", "main", "body", "table"}


def _named(value: str, words_out: set[str], inside: bool) -> tuple[bool, bool]:
    """Whether a class or id marks what is no main text, and whether it hints at it.

    A name marks if it is nothing but such words and plain ones (``comment-list``, ``sidebar-left``). One that has such a word among others
    (``share-prices``) hints, one that turns it round (``no-sidebar``, ``reply-count-3``) says nothing.
    """
    hint = False
    for name in value.split():
        words = {w.lower() for w in WORD.findall(name)}
        found = words & words_out
        if words & TURNED:
            continue
        if found and all(w in PLAIN or w in words_out or w.isdigit() for w in words):
            return True, False
        if not inside and "header" in words and all(w in PLAIN or w == "header" for w in words):
            return True, False
        hint = hint or bool(found or words & SUSPECTS)
    return False, hint


def _marked(tag: str, text: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element's name and attributes mark it as no main text, and whether they hint at it.

    Names of ``article`` elements mark only comments, those of the page and of ``main`` nothing; ids of headings are anchors.
    """
    if tag in OUT or (tag == "header" and not inside):
        return True, False
    hint = False
    if not text or tag in ("html", "body", "main"):
        return False, False
    words_out = COMMENTS if tag == "article" else WORDS_OUT
    for name, value in ATTRIBUTE.findall(text):
        name, value = name.lower(), value.strip("\"'")
        if name == "class" or (name == "id" and tag not in HEADINGS):
            bad, maybe = _named(value, words_out, inside or tag == "article")
            if bad:
                return True, False
            hint = hint or (maybe and tag != "article")
        elif tag == "article":
            continue
        elif name == "role" and value.lower() in ROLES_OUT:
            return True, False
        elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)):
            return True, False
    return False, hint


def page_blocks(page: str | None) -> list[tuple[int, str]]:
    """(zone, text) of each block of a page that has text, in page order."""
    out: list[tuple[int, str]] = []
    parts: list[str] = []
    # an open element: name, whether it starts an excluded zone, a suspect one, the main text
    stack: list[tuple[str, bool, bool, bool]] = []
    # places of open elements in it by name, of blocks and of walls, so that no tag walks through it
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    walls: list[int] = []
    excluded = suspect = inside = 0
    at, page = 0, page or ""
    zone = UNDECIDED

    def flush():
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            out.append((zone, text))

    def last(name: str) -> int:
        return places[name][-1] if places.get(name) else -1

    def close(index: int):
        nonlocal excluded, suspect, inside
        for name, bad, hint, good in stack[index:]:
            places[name].pop()
            if name in BLOCK:
                blocks.pop()
            if name in WALLS:
                walls.pop()
            excluded -= bad
            suspect -= hint
            inside -= good
        del stack[index:]

    def turn():
        nonlocal zone
        now = EXCLUDED if excluded else UNDECIDED if not inside else SUSPECT if suspect else MAIN
        if now != zone:
            flush()
            zone = now

    while at < len(page):
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
        at = m.end()
        if m.group(3) is None:
            if m.group(1):
                parts.append(m.group(1).replace("&", "&amp;"))
            continue
        tag, ending = m.group(3).lower(), bool(m.group(2))
        if tag in BLOCK:
            flush()
        elif tag == "br":
            parts.append(" ")
        if ending:
            i = last(tag)
            if i >= 0 and (tag in BLOCK or not walls or walls[-1] <= i):
                close(i)
            turn()
            continue
        if tag in RAW:
            end = RAW_END[tag].search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in VOID or (m.group(4).endswith("/") and tag not in BLOCK and tag not in OUT):
            continue
        if tag in BLOCK and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if tag in ENDS:
            i = max(map(last, ENDS[tag]))
            if i > max(map(last, SCOPE[tag])):
                close(i)
        if tag == "body" and places.get("head"):
            close(places["head"][0])
        bad, hint = _marked(tag, m.group(4), bool(inside))
        good = tag in ("article", "main") or (m.group(4) and re.search(r"""role\s*=\s*["']?(main|article)\b""", m.group(4), re.I) is not None)
        places.setdefault(tag, []).append(len(stack))
        if tag in BLOCK:
            blocks.append(len(stack))
        if tag in WALLS:
            walls.append(len(stack))
        stack.append((tag, bad, hint, bool(good)))
        excluded += bad
        suspect += hint
        inside += bool(good)
        turn()
    flush()
    return out


def long_runs(covered: np.ndarray, run: int) -> np.ndarray:
    """Without the short ends of runs that reach in from a neighbouring block, unless all is covered."""
    if covered.all():
        return covered
    edge = np.diff(np.r_[0, covered.astype(np.int8), 0])
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    out = np.zeros(len(covered), dtype=bool)
    for a, b in zip(begin, end, strict=True):
        out[a:b] = b - a >= run
    return out


def _number(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Streams:
    """The concatenated token streams of some pages of some hosts: tokens, offsets of blocks, and runs."""

    numbers: dict[str, int] = {}

    def __init__(self, pages: list[list[tuple[int, str]]], hosts: np.ndarray):
        words = [[t.split() for _, t in blocks] for blocks in pages]
        if len(self.numbers) > 500_000:
            self.numbers.clear()
        for w in {w for blocks in words for block in blocks for w in block}:
            if w not in self.numbers:
                self.numbers[w] = _number(w)
        self.words, self.hosts, self.pages = words, hosts, len(pages)
        self.tokens = np.array([self.numbers[w] for blocks in words for block in blocks for w in block], dtype=np.uint64)
        self.ends = offsets_of(np.array([len(block) for blocks in words for block in blocks], dtype=np.int64))
        self.page = np.repeat(np.arange(len(pages)), [len(b) for b in pages])
        self.zone = np.array([z for blocks in pages for z, _ in blocks], dtype=np.int64)
        self.owner = np.repeat(self.page, np.diff(self.ends))

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Page, begin and end of the runs that may repeat: whole blocks, as many in a row as make RUN_TOKENS, and all LONG_RUN tokens."""
        begin = np.flatnonzero(self.owner[: max(len(self.owner) - LONG_RUN + 1, 0)] == self.owner[LONG_RUN - 1 :])
        after = np.searchsorted(self.ends, self.ends[:-1] + RUN_TOKENS)
        block = np.flatnonzero(after < len(self.ends))
        block = block[self.page[after[block] - 1] == self.page[block]]
        start, stop = self.ends[block], self.ends[after[block]]
        short = stop - start < LONG_RUN  # longer blocks are covered by their runs of LONG_RUN
        return np.r_[self.page[block][short], self.owner[begin]], np.r_[start[short], begin], np.r_[stop[short], begin + LONG_RUN]

    def classes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A number for each run, equal for equal runs of one host, from the suffix array of the streams.

        The suffixes are ranked by their first token, and then, as often as needed, by the rank of their own first
        2**k tokens and the rank of the suffix 2**k tokens later. A run is told by the ranks at its begin and before its end.
        """
        length = end - begin
        ranks = [np.unique(self.tokens ^ self.hosts[self.owner], return_inverse=True)[1].reshape(-1).astype(np.int64)]
        while 4 << len(ranks) - 1 <= LONG_RUN:
            step, last = 1 << len(ranks) - 1, ranks[-1]
            later = np.zeros(len(last), dtype=np.int64)
            later[: max(len(last) - step, 0)] = last[step:] + 1
            ranks.append(np.unique(last * (len(last) + 2) + later, return_inverse=True)[1].reshape(-1))
        out = np.zeros(len(begin), dtype=np.int64)
        level = np.minimum(np.frexp(length)[1] - 1, len(ranks) - 1)
        for k, rank in enumerate(ranks):
            own = np.flatnonzero(level == k)
            out[own] = (rank[begin[own]] * (len(rank) + 1) + rank[end[own] - (1 << k)]) * (LONG_RUN + 1) + length[own]
        return out

    def hashes(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of runs and their hosts, the same wherever they stand."""
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(self.tokens), BASE)])
        back = np.multiply.accumulate(np.r_[np.uint64(1), np.full(len(self.tokens), pow(int(BASE), -1, 1 << 64), dtype=np.uint64)])
        sums = np.r_[np.uint64(0), np.cumsum(self.tokens * power[:-1], dtype=np.uint64)]
        return mixed((sums[end] - sums[begin]) * back[begin] ^ self.hosts[self.owner[begin]]).view(np.int64)

    def keys(self) -> np.ndarray:
        """A number for the host and content of each page: its number of tokens above a hash."""
        content = np.repeat(self.zone != EXCLUDED, np.diff(self.ends))
        owner, own = self.owner[content], self.tokens[content]
        many = np.bincount(owner, minlength=self.pages).astype(np.int64)
        at = np.arange(len(own)) - np.repeat(offsets_of(many)[:-1], many)
        power = np.multiply.accumulate(np.r_[np.uint64(1), np.full(int(many.max(initial=0)), BASE)])
        total = np.zeros(self.pages, dtype=np.uint64)
        np.add.at(total, owner, own * power[at])
        content = mixed(total ^ self.hosts)
        small, large = (many << bits | (content >> np.uint64(64 - bits)).astype(np.int64) for bits in (SIZE_BITS, LARGE_BITS))
        return np.where(many < LARGE, small, 1 << 62 | large)


def sizes(key: np.ndarray) -> np.ndarray:
    """The numbers of tokens in keys of pages."""
    return np.where(key >> 62 > 0, (key & (1 << 62) - 1) >> LARGE_BITS, key >> SIZE_BITS)


def mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits with all bits mixed."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def asks(blocks: list[tuple[int, str]]) -> list[bool]:
    """For each block whether the streams of the host decide about it."""
    marked = any(z in (MAIN, SUSPECT) for z, _ in blocks)
    return [z == SUSPECT or (z == UNDECIDED and not marked) for z, _ in blocks]


def extremes(run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each distinct run a place where it is, and the least, second least, second greatest and greatest key of the pages that have it; and for each run which one it is.

    A run of one key has it four times; one of two keys has each of them as a least and as a greatest.
    """
    if not len(run):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((4, 0), np.int64)
    order = np.argsort(run, kind="stable")
    r, k = run[order], key[order]
    new = np.r_[True, r[1:] != r[:-1]]
    first, number = np.flatnonzero(new), np.cumsum(new) - 1
    none = np.iinfo(np.int64)
    low, high = (f.reduceat(k, first) for f in (np.minimum, np.maximum))
    low2 = np.minimum(np.minimum.reduceat(np.where(k == low[number], none.max, k), first), high)
    high2 = np.maximum(np.maximum.reduceat(np.where(k == high[number], none.min, k), first), low)
    which = np.empty(len(r), np.int64)
    which[order] = number
    return order[first], which, np.stack([low, low2, high2, high])


def different(known: np.ndarray) -> np.ndarray:
    """Where the extreme keys of runs are no repeats of one before."""
    return np.r_[np.ones((1, known.shape[1]), bool), known[1:] > known[[0, 1, 1]]]


def covered_by(size: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


def unique_text(blocks: list[tuple[int, str]], words: list[list[str]], begin: np.ndarray, end: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, str]]:
    """A page's blocks, those asked about without boilerplate; the runs (begin, end) stand on pages with other keys, ``low`` to ``high``."""
    ends = offsets_of(np.array([len(w) for w in words], dtype=np.int64))
    size = int(ends[-1])
    # pages that have almost all of this page's content, and little else, are copies of it
    content = np.repeat(np.array([z != EXCLUDED for z, _ in blocks], dtype=bool), np.diff(ends))
    enough = COPY * content.sum()
    other, place = np.unique(np.r_[low, high], return_inverse=True)
    most = np.bincount(place.reshape(-1), np.r_[end - begin, end - begin], minlength=len(other))
    copies = [q for q in other[(most >= enough) & (COPY * sizes(other) <= content.sum())].tolist() if covered_by(size, begin[(low == q) | (high == q)], end[(low == q) | (high == q)])[content].sum() >= enough]
    chosen = ~(np.isin(low, copies) & np.isin(high, copies))
    covered = covered_by(size, begin[chosen], end[chosen])
    kept = []
    for k, ((zone, text), asked) in enumerate(zip(blocks, asks(blocks), strict=True)):
        if asked and (own := long_runs(covered[ends[k] : ends[k + 1]], LONG_RUN)).any():
            text = " ".join(w for w, c in zip(words[k], own.tolist(), strict=True) if not c)
        if text:
            kept.append((zone, text))
    return kept


def main_text(blocks: list[tuple[int, str]]) -> str:
    """The main blocks, or where a page marks none, what is left of the undecided."""
    best = (MAIN, SUSPECT) if any(z in (MAIN, SUSPECT) for z, _ in blocks) else (UNDECIDED,)
    return "\n".join(t for z, t in blocks if z in best)


def _blocks_of(table) -> list[list[tuple[int, str]]]:
    return [list(zip(z, t, strict=True)) for z, t in zip(table.column("zones").to_pylist(), table.column("texts").to_pylist(), strict=True)]


def _hosts_of(table) -> np.ndarray:
    column = table.column("host")
    return (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def decided(pages: pa.Table, answers: pa.Table | None = None) -> pa.Table:
    """(page_id, url, text) of the pages of a group. ``answers`` has what other groups of the host have: keys of pages with the same runs."""
    found = _blocks_of(pages)
    s = Streams(found, _hosts_of(pages))
    page, begin, end = s.runs()
    key = s.keys()[page]
    place, which, known = extremes(s.classes(begin, end), key)
    if answers is not None:
        run, other = (np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, dtype=np.int64) for x in answers.column(c).to_pylist()]]) for c in ("runs", "keys"))
        own = s.hashes(begin[place], end[place])
        order = np.argsort(own)
        at = order[np.searchsorted(own, run, sorter=order)]
        known = extremes(np.r_[which, at], np.r_[key, other])[2]
    hit = (known[0] < known[3])[which]
    low, high = (np.where(known[a][which] == key, known[b][which], known[a][which]) for a, b in ((0, 1), (3, 2)))
    order = np.argsort(page[hit], kind="stable")
    page, begin, end, low, high = (x[hit][order] for x in (page, begin, end, low, high))
    edge = np.searchsorted(page, np.arange(s.pages + 1))
    base = s.ends[np.searchsorted(s.page, np.arange(s.pages))] if len(s.page) else np.zeros(s.pages, np.int64)
    texts = []
    for i, blocks in enumerate(found):
        if edge[i] < edge[i + 1] and any(asks(blocks)):
            own = slice(edge[i], edge[i + 1])
            blocks = unique_text(blocks, s.words[i], begin[own] - base[i], end[own] - base[i], low[own], high[own])
        texts.append(main_text(blocks))
    return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array(texts, pa.string())})


def extract(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", text: str = "text") -> DataFrame:
    """(page_id, url, text) for every row."""
    batch_rows(df.sparkSession)
    name = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1))
    rows = df.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), F.xxhash64(name).alias("host"), F.xxhash64(page_id, url, html).alias("salt"))
    kind = df.schema[page_id].dataType.simpleString()

    def measured(batches):
        """Characters and blocks asked about of each host in a batch."""
        for whole in batches:
            hosts, at = np.unique(whole.column("host").to_numpy(), return_inverse=True)
            pages = whole.column("html").to_pylist()
            chars = np.bincount(at.reshape(-1), [len(p or "") for p in pages], len(hosts)).astype(np.int64)
            asked = np.bincount(at.reshape(-1), [sum(asks(page_blocks(p))) for p in pages], len(hosts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hosts), pa.array(chars), pa.array(asked)], names=["host", "chars", "asked"])

    sizes = rows.select("host", "html").mapInArrow(measured, "host long, chars long, asked long")
    hosts = written(sizes.groupBy("host").agg(F.sum("chars").alias("chars"), F.sum("asked").alias("asked")))
    seen = hosts.agg(F.sum("chars").alias("chars"), F.max((F.col("chars") > GROUP_CHARS) & (F.col("asked") > 0)).alias("exchange")).first()
    total = seen.chars or 0
    bins, buckets = max(1, -(-total // GROUP_CHARS)), max(LEAST_BUCKETS, -(-total // BUCKET_CHARS))
    large = hosts.where(F.col("chars") > GROUP_CHARS).select("host", F.ceil(F.col("chars") / GROUP_CHARS).alias("groups"), (F.col("asked") > 0).alias("exchange"))

    def parsed(batches):
        for whole in batches:
            for b in slices(whole, "html"):
                found = [page_blocks(h) for h in b.column("html").to_pylist()]
                zones, texts = pa.array([[z for z, _ in x] for x in found], pa.list_(pa.int8())), pa.array([[t for _, t in x] for x in found], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), b.column("host"), b.column("salt"), zones, texts], names=["page_id", "url", "host", "salt", "zones", "texts"])

    def sent(pages: pa.Table) -> pa.Table:
        """The distinct runs of a group's pages by bucket: their hashes, their extreme keys, and whether a page with anything to ask has them in its content."""
        found = _blocks_of(pages)
        s = Streams(found, _hosts_of(pages))
        page, begin, end = s.runs()
        place, which, known = extremes(s.classes(begin, end), s.keys()[page])
        content = offsets_of(np.repeat((s.zone != EXCLUDED).astype(np.int64), np.diff(s.ends)))
        asking = np.array([any(asks(x)) for x in found], dtype=bool)[page] & (content[end] > content[begin])
        asked = np.bincount(which[asking], minlength=len(place)) > 0
        new = different(known)
        run = np.broadcast_to(s.hashes(begin[place], end[place]), known.shape)
        table = np.stack([x.T[new.T] for x in (run, known, np.broadcast_to(asked.astype(np.int64), known.shape))])
        bucket = (table[0].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        table, bucket = table[:, order], bucket[order]
        cut = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]][: len(bucket)])
        parts = list(zip(cut.tolist(), [*cut[1:].tolist(), len(bucket)][: len(cut)], strict=True))
        columns = {"unit": pa.array([pages.column("unit")[0].as_py()] * len(parts), pa.int64()), "bucket": pa.array(bucket[cut])}
        columns |= {n: pa.array([c[a:b].tobytes() for a, b in parts], pa.binary()) for n, c in zip(("runs", "keys", "asked"), (table[0], table[1], table[2].astype(np.int8)), strict=True)}
        return pa.table(columns)

    def answered(table: pa.Table) -> pa.Table:
        """For each group the extreme keys of its runs asked about that it has not itself."""
        many = np.array([len(x) for x in table.column("asked").to_pylist()])
        run, key = (np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=np.int64) for c in ("runs", "keys"))
        asked = np.frombuffer(b"".join(table.column("asked").to_pylist()), dtype=np.int8)
        _, which, known = extremes(run, key)
        ends = offsets_of(many)
        # the keys of a run stand one after the other in what a group sent
        new = np.r_[True, run[1:] != run[:-1]]
        new[ends[:-1]] = True
        first, number = np.flatnonzero(new), np.cumsum(new) - 1
        known = known[:, which[first]]
        has = np.stack([np.bincount(number, key == k[number]) > 0 for k in known])
        use = different(known) & ~has & (asked[first] > 0)
        runs, keys = np.broadcast_to(run[first], use.shape).T[use.T], known.T[use.T]
        ends = offsets_of(use.sum(axis=0))[np.searchsorted(first, ends)].tolist()
        columns = [[x[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)] for x in (runs, keys)]
        return pa.table({"unit": table.column("unit"), **{n: pa.array(c, pa.binary()) for n, c in zip(("runs", "keys"), columns, strict=True)}})

    def last(pages: pa.Table, answers: pa.Table) -> pa.Table:
        if not pages.num_rows:
            return pa.table({"page_id": pages.column("page_id"), "url": pages.column("url"), "text": pa.array([], pa.string())})
        return decided(pages, answers if pages.column("exchange")[0].as_py() else None)

    out = f"page_id {kind}, url string, text string"
    blocks = rows.mapInArrow(parsed, f"page_id {kind}, url string, host long, salt long, zones array<tinyint>, texts array<string>").join(large, "host", "left")
    # pages of a large host go to one of its groups, other hosts go whole to one of the bins
    unit = F.when(F.col("groups").isNull(), F.pmod("host", F.lit(bins))).otherwise(F.xxhash64("host", F.pmod("salt", "groups")))
    groups = blocks.select("page_id", "url", "host", "zones", "texts", F.coalesce("exchange", F.lit(False)).alias("exchange"), unit.alias("unit"))
    by_unit = groups.groupBy("unit")
    if seen.exchange:
        runs = groups.where("exchange").groupBy("unit").applyInArrow(sent, "unit long, bucket long, runs binary, keys binary, asked binary")
        answers = runs.groupBy("bucket").applyInArrow(answered, "unit long, runs binary, keys binary")
        done = by_unit.cogroup(answers.groupBy("unit")).applyInArrow(last, out)
    else:
        done = by_unit.applyInArrow(lambda pages: decided(pages), out)
    return done.withColumnsRenamed({"page_id": page_id, "url": url, "text": text})

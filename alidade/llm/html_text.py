"""HTML extraction: page structure names what it can, and a suffix array over a host's pages finds the rest.

A page is read into blocks of text. A block is `dropped` if it stands in markup that names it a menu, header,
footer, sidebar, notice, advert, form or comment; `main` if it stands in an article or main element; and
`open` otherwise. The token streams of the pages of one host are concatenated, and their suffix array gives the
runs of `run` tokens or more that stand on two or more distinct pages, which differ in id and in content (the tokens
that are not in dropped blocks), so that copies of a page under several addresses say nothing against each other.
The tokens of such runs within a block are cut out of open blocks, and what is left of a block is joined; runs over the
edges of blocks count for blocks that runs cover wholly. Pages without main blocks keep the unique runs of their open blocks.

A page with main blocks keeps just those, less the host's notices: the runs of main blocks that stand in more than half of the distinct
main texts of the host, and in `few` of them or more, on as many page ids. Two pages are not enough there, as hosts also serve one article under several
addresses and articles quote each other. A text counts for such runs only if they all cover no more than half of its tokens: else
it is a near copy of other articles rather than one with a notice.

Defined results: null or empty html gives an empty text; unclosed and stray tags are read as far as they
make sense; an unclosed comment or script reaches to the end; pages whose url is null or names no host are compared with no page; repeated
rows stay rows of their own (and are one page for the repetition test if their page ids are equal);
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import collections
import html as entities
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.llm.common import BROADCAST_ROWS, id_field, if_small, release, saved, small_batches
from alidade.llm.words import content_hashes, gram_hashes, word_hashes, word_spans

DROPPED, OPEN, MAIN, DOUBTFUL = 0, 1, 2, 3
#: How markup begins: a comment, a section of data, a declaration, or a tag with its name.
MARKUP = re.compile(r"<(?:(?P<comment>!--)|(?P<data>!\[CDATA\[)|(?P<other>[!?])|(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*))")
QUOTE_OR_END = re.compile(r"[>\"']")
#: One attribute after another: a name, and a value if it has one.
ATTR = re.compile(r"""([^\s/>][^\s/=>]*)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: Elements whose content is no text of the page.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "math", "canvas", "audio", "video"}
#: Elements that are boilerplate by name.
BOILERPLATE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "fieldset", "label", "head"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form", "toolbar"}
#: Class names and ids that name boilerplate, also several of them joined, such as cookie-notice.
NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "promo", "banner", "nav", "navbar", "navigation", "menu", "header", "footer",
    "sidebar", "aside", "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "notice", "popup", "modal", "overlay", "newsletter", "subscribe", "signup",
    "login", "share", "sharing", "social", "related", "comment", "comments", "disqus", "replies", "respond", "pagination", "pager", "widget", "toolbar", "skip", "masthead", "copyright",
}
BLOCKS = {
    "p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "blockquote", "pre",
    "section", "article", "main", "figure", "figcaption", "hr", "address", "body", "html", "details", "summary", "center",
} | BOILERPLATE
#: Elements without content.
VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr", "param"}
#: Elements that are followed from start to end tag.
NESTED = BLOCKS - VOID - {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "html", "body"} | {"span"}
JOINT = re.compile(r"[-_]+")
#: Slots of the sketch of a host's runs; runs of equal slots share a counter.
SLOTS = 1 << 16
#: Slot entries that a task holds at once, and slots of a host that are listed; a host with more has all of them read.
HELD_SLOTS, LISTED_SLOTS = 8 << 20, 512


def _named(attrs: str) -> tuple[bool, bool, bool]:
    """Whether the attributes hide the element or give it a role of boilerplate, whether class or id name boilerplate, and whether the role is main."""
    found: dict[str, str] = {}
    for key, value in ATTR.findall(attrs):
        found.setdefault(key.lower(), (value[1:-1] if value[:1] in ("'", '"') else value).lower())  # the first of a name counts
    role = found.get("role", "").strip()
    names = f"{found.get('class', '')} {found.get('id', '')}".split()
    hard = role in ROLES or "hidden" in found or found.get("aria-hidden", "").strip() == "true"
    return hard, any(all(w in NAMES for w in JOINT.split(n)) for n in names), role == "main"


def _tags(page: str, at: list[int]) -> Iterator[tuple[int, bool, str | None, str]]:
    """Begin of each piece of markup from at[0] on, whether it is an end tag, its name (None if it is no tag) and attributes; at[0] is then its end.

    A tag ends at the first > outside quotes; if there is none, or after 16 times the page's length was looked through in vain for
    such, at the first > at all; without one it is text. So the time is in proportion to the page.
    """
    last, left = page.rfind(">"), 16 * len(page)
    while (m := MARKUP.search(page, at[0])) is not None:
        if m["comment"] or m["data"]:
            end = page.find("-->" if m["comment"] else "]]>", m.end())
            at[0] = len(page) if end < 0 else end + 3
            yield m.start(), False, None, ""
            continue
        if last < m.end():  # no tag ends any more: what is left is text
            return
        end = -1
        if not m["other"] and left > 0:
            place = m.end()
            while (mark := QUOTE_OR_END.search(page, place)) is not None:
                if mark[0] == ">":
                    end = mark.end()
                    break
                close = page.find(mark[0], mark.end())
                if close < 0:
                    break
                place = close + 1
            if end < 0:
                left -= len(page) - m.end()
        at[0] = end if end > 0 else page.find(">", m.end()) + 1
        yield m.start(), m["close"] == "/", m["name"], page[m.end() : at[0] - 1]


def _raw_end(page: str, name: str, at: int) -> int:
    """Where the end tag of an element whose content is no text ends, or the page's end."""
    found = re.compile(rf"</{re.escape(name)}\b", re.IGNORECASE).search(page, at)
    end = page.find(">", found.end()) if found else -1
    return end + 1 if end >= 0 else len(page)


def read_blocks(page: str) -> list[tuple[str, int]]:
    """The page's blocks in order, white space made one space, with DROPPED, OPEN or MAIN.

    A class or id does not drop an article or main element, nor the main element within. An article within an element so named
    is main if the page has no other main block, and dropped if it has, as teasers and comments are.
    """
    blocks: list[tuple[str, int]] = []
    held: list[str] = []
    stack: list[tuple[str, tuple[bool, bool, int]]] = []  # name, and what holds within: dropped, dropped by class or id, kind
    loose = False  # within an element that drops its text and is not followed by its end tag (p, li, h1 ...)
    state = plain = (False, False, OPEN)
    at, before = [0], 0
    opened: collections.Counter[str] = collections.Counter()  # of the names in stack

    def flush() -> None:
        if held:
            words = " ".join(entities.unescape("".join(held)).split())
            if words:
                blocks.append((words, DROPPED if state[0] or state[1] or loose else state[2]))
            held.clear()

    for begin, closes, name, attrs in _tags(page, at):
        if begin > before:
            held.append(page[before:begin])
        before = at[0]
        if name is None:
            continue
        name = name.lower()
        if closes:
            if name in BLOCKS:
                flush()
                if name not in NESTED:
                    loose = False
            if name in NESTED and opened[name]:
                while True:
                    top = stack.pop()
                    opened[top[0]] -= 1
                    if top[0] == name:
                        break
                state = stack[-1][1] if stack else plain
            continue
        if name in RAW:
            if not attrs.rstrip().endswith("/"):
                before = at[0] = _raw_end(page, name, at[0])
            continue
        if name == "br":
            held.append(" ")
            continue
        if name in BLOCKS:
            flush()
            loose = False
        if name in VOID:
            continue
        hard, named, main = _named(attrs) if attrs.strip() else (False, False, False)
        if name in NESTED:
            if name != "span" or hard or named:  # other spans are inline and may nest freely
                if name == "span":
                    flush()
                dropped = state[0] or hard or name in BOILERPLATE
                if main or name == "main":
                    state = (dropped, False, MAIN)
                elif name == "article":
                    state = (dropped, False, DOUBTFUL if state[1] or state[2] == DOUBTFUL else MAIN)
                else:
                    state = (dropped, state[1] or named, state[2])
                stack.append((name, state))
                opened[name] += 1
        elif (hard or named) and name in BLOCKS and name not in ("html", "body"):
            loose = True
    held.append(page[before:])
    flush()
    doubtful = DROPPED if any(kind == MAIN for _, kind in blocks) else MAIN
    return [(b, doubtful if kind == DOUBTFUL else kind) for b, kind in blocks]


def suffix_order(symbols: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffix array by prefix doubling up to `run` symbols or more, and the rank of each suffix in it.

    Suffixes that agree in `run` symbols have equal ranks.
    """
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    n, done = len(rank), 1
    order = np.argsort(rank, kind="stable")
    while done < run:
        step = min(done, run - done)
        after = np.full(n, -1, np.int64)
        after[: max(n - step, 0)] = rank[step:]
        key = rank * (n + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.ones(n, np.int64)
        new[1:] = key[order[1:]] != key[order[:-1]]
        new[:1] = 0
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        done += step
    return order, rank


def token_codes(pages: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all tokens, where each block's tokens begin, and where each page's."""
    texts = [b.encode() for blocks in pages for b in blocks]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    starts, ends, first = word_spans(data, offsets)
    return word_hashes(data, starts, ends), first, first[np.concatenate([[0], np.cumsum([len(b) for b in pages])]).astype(np.int64)]


def run_places(codes: np.ndarray, limits: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Where runs that stay within their page begin, and their hashes, which are equal for equal runs of any page."""
    at = np.flatnonzero(np.arange(len(codes)) + run <= np.repeat(limits[1:], np.diff(limits)))
    return at, gram_hashes(codes, run)[at].view(np.int64)


def page_contents(codes: np.ndarray, first: np.ndarray, limits: np.ndarray, kinds: list[int]) -> np.ndarray:
    """A hash of each page's tokens that are not in dropped blocks."""
    stays = np.repeat(np.array(kinds, np.int64) != DROPPED, np.diff(first))
    limits = np.concatenate([[0], np.cumsum(stays)])[limits]
    return content_hashes(codes[stays].tobytes(), (limits[:-1] * 8).tolist(), (limits[1:] * 8).tolist()).view(np.int64)


def ranked_runs(codes: np.ndarray, limits: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run that stays within its page the hash, the page, and the rank in the suffix array of the pages' streams, which is equal for equal runs."""
    page_of = np.repeat(np.arange(len(limits) - 1), np.diff(limits))
    at, hashes = run_places(codes, limits, run)
    # A sign of its own after each page, so that no run goes on into the next page.
    symbols = np.insert(codes, limits[1:], np.arange(len(limits) - 1, dtype=np.uint64))
    return hashes, page_of[at], suffix_order(symbols, run)[1][at + page_of[at]]


def runs_by_page(codes: np.ndarray, limits: np.ndarray, same: np.ndarray, run: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of the pages by the suffix array, each once for all pages of equal numbers in `same`: their hashes and one such page."""
    hashes, page, rank = ranked_runs(codes, limits, run)
    place = np.unique(rank * (int(same.max(initial=0)) + 1) + same[page], return_index=True)[1]
    return hashes[place], page[place]


def run_slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(48)).astype(np.int64)


def packed_counts(slots: np.ndarray) -> bytes:
    """How often each slot is there, packed."""
    found, counts = np.unique(slots, return_counts=True)
    return zlib.compress(np.diff(found, prepend=0).astype("<u2").tobytes() + counts.astype("<u4").tobytes(), 1)


def add_counts(total: np.ndarray, packed: bytes) -> None:
    """Add packed counts to an array of SLOTS counters."""
    raw = zlib.decompress(packed)
    n = len(raw) // 6
    total[np.cumsum(np.frombuffer(raw, "<u2", n).astype(np.int64))] += np.frombuffer(raw, "<u4", n, 2 * n)


def distinct_runs(codes: np.ndarray, limits: np.ndarray, hosts: np.ndarray, ids: np.ndarray, contents: np.ndarray, run: int) -> tuple[np.ndarray, ...]:
    """The distinct runs of each host, by the suffix array of the pages' streams: host, hash, and of the pages they stand on the least and greatest id and content.

    If both ids and contents differ, then two of the pages differ in both.
    """
    hashes, page, rank = ranked_runs(codes, limits, run)
    names, number = np.unique(hosts, return_inverse=True)
    _, place, same = np.unique(rank * len(names) + number[page], return_index=True, return_inverse=True)
    limits_of = []
    for mark in (ids, contents):
        for among in (np.minimum, np.maximum):
            limits_of.append(mark[page[place]])
            among.at(limits_of[-1], same, mark[page])
    return hosts[page[place]], hashes[place], *limits_of


def covered_tokens(codes: np.ndarray, first: np.ndarray, limits: np.ndarray, run: int, shared: list[np.ndarray]) -> np.ndarray:
    """Whether each token is in a run of its block that is among the shared ones given for its page, or in a block that such runs, of any blocks, cover wholly.

    A run over a block's edge so takes no words off a block that is else unique.
    """
    at, hashes = run_places(codes, limits, run)
    edges = np.searchsorted(at, limits)
    hits = [at[a:z][np.isin(hashes[a:z], some)] for a, z, some in zip(edges[:-1], edges[1:], shared, strict=True)]
    hit = np.concatenate([np.zeros(0, np.int64), *hits])
    block = np.repeat(np.arange(len(first) - 1), np.diff(first))

    def cover(starts: np.ndarray) -> np.ndarray:
        change = np.zeros(len(codes) + 1, np.int64)
        np.add.at(change, starts, 1)
        np.add.at(change, starts + run, -1)
        return np.cumsum(change)[:-1] > 0

    open_ones = np.bincount(block[~cover(hit)], minlength=len(first))
    return cover(hit[block[hit] == block[hit + run - 1]]) | (open_ones[block] == 0)


def repeated_tokens(pages: list[list[str]], ids: list, run: int) -> list[np.ndarray]:
    """For each page of one host the share of each block's tokens that runs of `run` tokens on two or more distinct pages cover."""
    codes, first, limits = token_codes(pages)
    number = np.unique(np.array([repr(i) for i in ids]), return_inverse=True)[1]
    contents = page_contents(codes, first, limits, [OPEN] * (len(first) - 1))
    _, hashes, low, high, least, most = distinct_runs(codes, limits, np.zeros(len(pages), np.int64), number, contents, run)
    covered = covered_tokens(codes, first, limits, run, [hashes[(low < high) & (least < most)]] * len(pages))
    total = np.concatenate([[0], np.cumsum(covered)])
    share = (total[first[1:]] - total[first[:-1]]) / np.maximum(np.diff(first), 1)
    return np.split(share, np.cumsum([len(b) for b in pages])[:-1])


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", run: int = 8, shard_pages: int = 256, few: int = 8
) -> DataFrame:
    """Return id_col, url_col and text for every row.

    Repetition is judged over all pages of a host, by suffix arrays over shard_pages pages at a time. For open blocks, on hosts with a page
    that has some and no main ones, they give each host's distinct runs, with the least and greatest
    id and content of the pages they stand on; these are combined by the hash of the run, before the shuffle and after it, so that neither
    a host of any size nor a run on all its pages is a task of its own. shard_pages is a matter of memory: the text does not depend on it.

    For main blocks they give the distinct runs of each main text. A sketch counts these by host and slot of the run, so that a slot's counter is no
    less than the number of texts with any of its runs; only runs of slots above half of the host's texts are then counted exactly, and those
    that are in more than half of the texts once more, in the texts that they cover no more than half.
    """
    kinds = [id_field(pages, id_col, "id"), id_field(pages, url_col, "url")]
    out = T.StructType([*kinds, T.StructField("text", T.StringType())])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[list[tuple[str, int]]]]]:
        for batch in small_batches(batches):
            for k in range(0, batch.num_rows, shard_pages):
                part = batch.slice(k, shard_pages)
                yield part, [read_blocks(p) for p in part.column("text").to_pylist()]

    def asks(blocks: list[tuple[str, int]]) -> bool:
        found = {kind for _, kind in blocks}
        return OPEN in found and MAIN not in found

    def main_texts(part: pa.RecordBatch, read: list[list[tuple[str, int]]]) -> tuple[np.ndarray, ...]:
        """Token codes and page limits of the main blocks, the pages' contents, and equal numbers for equal hosts and contents."""
        codes, first, limits = token_codes([[b for b, kind in blocks if kind == MAIN] for blocks in read])
        contents = page_contents(codes, first, limits, [MAIN] * (len(first) - 1))
        return codes, limits, contents, np.unique(np.stack([np.asarray(part.column("host")), contents]), axis=1, return_inverse=True)[1].ravel()

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hosts that are asked about, contents of main texts, and counts of the slots of their runs."""
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def rows(hosts: list, asked: list, contents: list, slots: list) -> pa.RecordBatch:
            columns = zip((hosts, asked, contents, slots), (pa.int64(), pa.bool_(), pa.int64(), pa.binary()), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in columns], ["host", "asks", "content", "slots"])

        def counted() -> pa.RecordBatch:
            out = rows(list(held), [False] * len(held), [None] * len(held), [packed_counts(np.concatenate(s)) for s in held.values()])
            held.clear()
            return out

        for part, read in parts(batches):
            hosts = np.asarray(part.column("host"))
            asked = np.unique(hosts[[asks(blocks) for blocks in read]]).tolist()
            yield rows(asked, [True] * len(asked), [None] * len(asked), [None] * len(asked))
            codes, limits, contents, same = main_texts(part, read)
            texts = np.unique(np.where(np.diff(limits) > 0, same, -1), return_index=True)
            texts = texts[1][texts[0] >= 0]
            yield rows(hosts[texts].tolist(), [False] * len(texts), contents[texts].tolist(), [None] * len(texts))
            hashes, page = runs_by_page(codes, limits, same, run)
            key = np.unique(same[page] * SLOTS + run_slots(hashes))  # a text counts once in a slot
            of = np.zeros(len(same) + 1, np.int64)
            of[same] = hosts
            of = of[key // SLOTS]
            order = np.argsort(of, kind="stable")
            names, edges = np.unique(of[order], return_index=True)
            for name, slots in zip(names.tolist(), np.split((key % SLOTS).astype(np.uint16)[order], edges[1:]), strict=False):
                held.setdefault(name, []).append(slots)
                size += len(slots)
            if size >= HELD_SLOTS:
                yield counted()
                size = 0
        yield counted()

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The slots of each host, whose rows stand together, that are counted for more than half of its n texts; an empty list if they are many."""
        last, most, total = None, 0, np.zeros(SLOTS, np.int64)

        def found() -> pa.RecordBatch:
            slots = np.flatnonzero(2 * total > most).tolist() if last is not None else []
            known = [last] if slots else []
            return pa.RecordBatch.from_arrays([pa.array(known, pa.int64()), pa.array([slots if len(slots) <= LISTED_SLOTS else []][: len(known)], pa.list_(pa.int32()))], ["host", "slots"])

        for batch in batches:
            for name, packed, n in zip(*(batch.column(c).to_pylist() for c in ("host", "slots", "n")), strict=True):
                if name != last:
                    yield found()
                    last, most = name, n
                    total[:] = 0
                add_counts(total, packed)
        yield found()

    def shared_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs of main texts in frequent slots, with the content and number of their pages."""
        for part, read in parts(batches):
            codes, limits, contents, _ = main_texts(part, read)
            hashes, page = runs_by_page(codes, limits, np.arange(len(read)), run)
            wanted = [np.array(s, np.int64) for s in part.column("slots").to_pylist()]
            slots = run_slots(hashes)
            order = np.argsort(page, kind="stable")
            edges = np.searchsorted(page[order], np.arange(len(read) + 1))
            some = [k[np.isin(slots[k], w)] if len(w) else k for w, k in zip(wanted, np.split(order, edges[1:-1]), strict=True)]
            some = np.concatenate([np.zeros(0, np.int64), *some])
            taken = pa.array(page[some])
            yield pa.RecordBatch.from_arrays([part.column("host").take(taken), pa.array(hashes[some]), pa.array(contents[page[some]]), part.column("number").take(taken)],
                                             ["host", "run", "content", "number"])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in parts(batches):
            codes, first, limits = token_codes([[b for b, _ in blocks] for blocks in read])
            contents = page_contents(codes, first, limits, [kind for blocks in read for _, kind in blocks])
            columns = distinct_runs(codes, limits, np.asarray(part.column("host")), np.asarray(part.column("number")), contents, run)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["host", "run", "low", "high", "least", "most"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in parts(batches):
            codes, _, limits = token_codes([[b for b, _ in blocks] if asks(blocks) else [] for blocks in read])
            at, hashes = run_places(codes, limits, run)
            page = pa.array(np.searchsorted(limits, at, "right") - 1)
            yield pa.RecordBatch.from_arrays([part.column("host").take(page), pa.array(hashes), part.column("r").take(page)], ["host", "run", "r"])

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The runs among those given for a page's host that stand in its main text, if they cover no more than half of it."""
        for part, read in parts(batches):
            codes, first, limits = token_codes([[b for b, kind in blocks if kind == MAIN] for blocks in read])
            contents = page_contents(codes, first, limits, [MAIN] * (len(first) - 1))
            shared = [np.array(r, np.int64) for r in part.column("runs").to_pylist()]
            covered = np.concatenate([[0], np.cumsum(covered_tokens(codes, first, limits, run, shared))])[limits]
            at, hashes = run_places(codes, limits, run)
            edges = np.searchsorted(at, limits)
            found = [np.unique(hashes[a:z][np.isin(hashes[a:z], r)]) for a, z, r in zip(edges[:-1], edges[1:], shared, strict=True)]
            found = [r if v else r[:0] for r, v in zip(found, 2 * np.diff(covered) <= np.diff(limits), strict=True)]
            page = np.repeat(np.arange(len(read)), [len(r) for r in found])
            taken = pa.array(page)
            yield pa.RecordBatch.from_arrays([part.column("host").take(taken), pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(contents[page]), part.column("number").take(taken)],
                                             ["host", "run", "content", "number"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, read in parts(batches):
            mains = [[(b, kind) for b, kind in blocks if kind == MAIN] for blocks in read]
            runs = [(n if main else r) for r, n, main in zip(part.column("runs").to_pylist(), part.column("notices").to_pylist(), mains, strict=True)]
            streams = [main or blocks for main, blocks in zip(mains, read, strict=True)]
            codes, first, limits = token_codes([[b for b, _ in blocks] for blocks, r in zip(streams, runs, strict=True) if r is not None])
            stays = ~covered_tokens(codes, first, limits, run, [np.array(r, np.int64) for r in runs if r is not None])
            texts, block = [], 0
            for blocks, r in zip(streams, runs, strict=True):
                kept = [b for b, kind in blocks if kind != DROPPED]  # either main blocks or open ones
                if r is not None:
                    edges = first[block : block + len(blocks) + 1]
                    block += len(blocks)
                    pairs = zip(blocks, edges[:-1], edges[1:], strict=True)
                    kept = [" ".join(itertools.compress(b.split(" "), stays[a:z].tolist())) for (b, kind), a, z in pairs if kind != DROPPED]
                texts.append("\n\n".join(b for b in kept if b))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    def notices_of(known: DataFrame, seen: DataFrame) -> DataFrame | None:
        """The runs that are notices of each host, if there are any."""
        texts = saved(seen.where("content is not null").groupBy("host").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= few), "page-texts")
        slots = seen.where("slots is not null").select("host", "slots").join(if_small(texts), "host").repartition("host").sortWithinPartitions("host")
        slots = saved(slots.mapInArrow(frequent, "host long, slots array<int>"), "page-slots")
        if slots.isEmpty():
            return None

        def often(runs: DataFrame, name: str) -> DataFrame:
            """The runs of each host that stand in more than half of its texts, and in few or more."""
            runs = runs.groupBy("host", "run").agg(F.least(F.count_distinct("content"), F.count_distinct("number")).alias("pages"))
            runs = runs.where(F.col("pages") >= few).join(if_small(texts), "host").where("2 * pages > n")
            return saved(runs.groupBy("host").agg(F.collect_list("run").alias("runs")), name)

        found = "host long, run long, content long, number long"
        runs = often(known.join(if_small(slots), "host").mapInArrow(shared_runs, found), "page-shared")
        if runs.isEmpty():
            return None
        return if_small(often(known.join(if_small(runs), "host").mapInArrow(votes, found), "page-notices")).withColumnRenamed("runs", "notices")

    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("text"))
    rows = rows.select("*", F.xxhash64("id", "url", "text").alias("r"), F.xxhash64("id").alias("number"), F.when(host(F.col("url")) != "", F.xxhash64(host(F.col("url")))).alias("host"))
    known = rows.where("host is not null")
    seen = saved(known.mapInArrow(survey, "host long, asks boolean, content long, slots binary"), "page-survey")
    hosts = saved(seen.where("asks").select("host").distinct(), "page-hosts")
    # Many hosts are not broadcast: all pages are read then, which changes no result, as runs meet by host.
    some = known.join(F.broadcast(hosts), "host", "left_semi") if hosts.count() <= BROADCAST_ROWS else known
    shared = some.mapInArrow(emit, "host long, run long, low long, high long, least long, most long").groupBy("host", "run")
    shared = shared.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.min("least").alias("least"), F.max("most").alias("most"))
    # Written first, so that either this side is broadcast or the join may split the rows of a hot run.
    shared = if_small(saved(shared.where("low < high and least < most").select("host", "run"), "page-runs"))
    cuts = some.mapInArrow(own, "host long, run long, r long").join(shared, ["host", "run"], "left_semi")
    cuts = saved(cuts.groupBy("r").agg(F.collect_set("run").alias("runs")), "page-cuts")  # no more than a page has tokens
    if (cuts.agg(F.sum(F.size("runs"))).first()[0] or 0) <= BROADCAST_ROWS:
        cuts = F.broadcast(cuts)
    notices = notices_of(known, seen)
    release(seen)
    rows = rows.join(cuts, "r", "left")
    rows = rows.withColumn("notices", F.lit(None).cast("array<bigint>")) if notices is None else rows.join(notices, "host", "left")
    return rows.select("id", "url", "text", "runs", "notices").mapInArrow(cut, out).toDF(id_col, url_col, "text")

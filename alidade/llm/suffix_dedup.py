"""Suffix-array dedup: every byte of a long string that starts anywhere else too is removed.

Texts meet in shards of spans (see repeats). A shard's spans are cut into tokens wherever the hash of the next few bytes says so. A token's number
is its rank among the bytes of all tokens, taken with those next bytes, so that suffixes of the token string are ordered as their bytes are. Their
suffix array is built by linear grouping: suffixes are grouped by Lyndon prefixes, groups
being processed in descending order by means of previous-smaller pointers; then each group's order is
emitted by one walk over the array, without renaming tokens in rounds. A window is the last bytes of a token, or all of it, and the
beginning of the next suffix, which neighbours in the array share or not; what comes before suffixes is ordered from its end backwards. Windows that hold no token's
beginning, as in a phrase over and over, go through the same once more with shorter tokens, and at last by single bytes. Bytes decide, not hashes.

Defined results: a null or empty text has 0 bytes; matches never cross texts, so a text shorter than the
window keeps all; strings are judged on the input; a row repeated whole is a match for itself; very long texts
are read in segments; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from alidade.llm.repeats import Unit, remove_repeats
from alidade.llm.words import mix

#: A token has so many bytes on average, and its beginning depends on so many bytes from there on. Each but the first is for windows without such a beginning.
TOKENS = ((40, 8), (6, 5), (1, 0))


def linear_suffix_array(symbols: list[int]) -> list[int]:
    """The suffix array of symbols by linear grouping; an end that is smaller than all symbols is understood.

    All lists have a place for the end, n. order holds the suffixes group by group, place is its inverse, and a group
    is known by where it begins; tail has where it ends.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    order.insert(0, n)
    place, group, tail = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    begin = 0
    for at in range(1, n + 1):
        s = order[at]
        if at == 1 or symbols[s] != symbols[order[at - 1]]:
            begin = at
        place[s], group[s], tail[begin] = at, begin, at
    smaller = [-1] * (n + 1)  # the previous suffix in a smaller group; where there is none, group[-1] and done[-1] of the end stop a walk
    at = n
    while at > 0:
        s = order[at]
        begin = group[s]
        if begin == at:  # alone in its group
            p = s - 1
            while group[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                old = group[p]
                end = tail[old]
                if end > old:
                    q, to = order[end], place[p]
                    order[to], place[q], order[end], place[p] = q, to, p, end
                    tail[old], tail[end], group[p] = end - 1, end, end
            at = begin - 1
            continue
        # Suffixes of this group whose previous smaller one is p follow it in a row: p's Lyndon prefix grows by them.
        before = []
        for s in sorted(order[begin : at + 1]):
            p = s - 1
            while group[p] >= begin:
                p = smaller[p]
            smaller[s] = p
            if p >= 0:
                before.append(p)
        layers = [before]
        if len(set(before)) < len(before):
            grown: dict[int, int] = {}
            for p in before:
                grown[p] = grown.get(p, 0) + 1
            by_times: dict[int, list[int]] = {}
            for p, times in grown.items():
                by_times.setdefault(times, []).append(p)
            layers = [by_times[times] for times in sorted(by_times, reverse=True)]
        for layer in layers:
            # The more often a prefix grew, the greater its suffix: such go to the end of their old group, which shrinks.
            ends: dict[int, int] = {}
            for p in layer:
                old = group[p]
                end = tail[old]
                if old not in ends:
                    ends[old] = end
                q, to = order[end], place[p]
                order[to], place[q], order[end], place[p] = q, to, p, end
                tail[old] = end - 1
            for p in layer:
                group[p] = tail[group[p]] + 1
            for old, end in ends.items():
                tail[tail[old] + 1] = end
        at = begin - 1
    # Suffixes whose next smaller suffix is s come next in their groups when s has its final place.
    free = list(range(n + 1))
    done = [False] * n + [True]
    for at in range(n + 1):
        s = order[at] - 1
        while not done[s]:
            done[s] = True
            to = group[s]
            order[free[to]] = s
            free[to] += 1
            s = smaller[s]
    return order[1:]


def repeated_windows(contents: list[bytes], times: list[int], window: int) -> list[list[int]]:
    """For each span, which stands times[k] times, the limits of the bytes that repeated windows cover."""
    raw = np.frombuffer(b"".join(contents), np.uint8)
    limits = np.concatenate([[0], np.cumsum([len(c) for c in contents])]).astype(np.int64)
    flags = _covered(raw, limits, np.array(times, np.int64), window)
    # Limits of the runs of true flags, which end with their span at the latest.
    edge = np.zeros(len(raw) + 1, bool)
    edge[1:-1] = flags[1:] != flags[:-1]
    edge[limits] = True
    edge = np.flatnonzero(edge)
    runs = np.stack([edge[:-1], edge[1:]], axis=1)[flags[edge[:-1]]]
    at = np.searchsorted(runs[:, 0], limits)
    runs = (runs - limits[np.searchsorted(limits, runs[:, :1], "right") - 1]).ravel().tolist()
    return [runs[2 * a : 2 * z] for a, z in zip(at.tolist(), at[1:].tolist(), strict=False)]


def _covered(raw: np.ndarray, limits: np.ndarray, weight: np.ndarray, window: int, level: int = 0) -> np.ndarray:
    """Whether a repeated window covers each byte, for spans raw[limits[k] : limits[k + 1]] that stand weight[k] times.

    A window without the beginning of a token equals only such windows: long tokens are looked through once more with other tokens.
    """
    size, ahead = TOKENS[level]
    ahead = min(ahead, window // 2)
    edges = _token_edges(raw, limits, size, ahead)
    change = np.zeros(len(raw) + 1, np.int64)
    _mark(change, raw, limits, edges, weight, window, ahead)
    # Windows that hold no edge but the first: they begin at an edge or after it, and end `ahead` bytes after the next one or before.
    span = np.searchsorted(limits, edges, "right") - 1
    after = np.append(edges[1:], len(raw))
    last = np.where(after >= limits[span + 1], limits[span + 1] - window, after - window + ahead - 1)
    inner = np.flatnonzero(last >= edges)
    if ahead and len(inner):
        sizes = last[inner] + window - edges[inner]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        place = np.arange(starts[-1]) + np.repeat(edges[inner] - starts[:-1], sizes)
        covered = place[_covered(raw[place], starts, weight[span[inner]], window, level + 1)]
        np.add.at(change, covered, 1)
        np.add.at(change, covered + 1, -1)
    return np.cumsum(change[:-1]) > 0


def _token_edges(raw: np.ndarray, limits: np.ndarray, size: int, ahead: int) -> np.ndarray:
    """Where tokens begin: at the beginning of a span, and where the next `ahead` bytes, all of the span, say so, or at each byte if there are none."""
    if not ahead:
        return np.arange(len(raw))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw),), "<u8", padded, 0, (1,)) & np.uint64((1 << 8 * ahead) - 1)
    edge = mix(eight + np.uint64(ahead)) % np.uint64(size) == 0
    for k in range(1, ahead):
        edge[limits[1:] - k] = False  # spans are longer than that
    edge[limits[:-1]] = True
    return np.flatnonzero(edge)


def _mark(change: np.ndarray, raw: np.ndarray, limits: np.ndarray, edges: np.ndarray, weight: np.ndarray, window: int, ahead: int) -> None:
    """Count up where repeated windows begin and down where they end: of windows whose first edge after their beginning has `ahead` bytes of them after it."""
    span = np.searchsorted(limits, edges, "right") - 1
    ends = limits[span + 1]
    after = np.minimum(np.append(edges[1:], len(raw)), ends)
    data = raw.tobytes()
    tokens = [data[a:z] for a, z in zip(edges.tolist(), np.minimum(after + ahead, ends).tolist(), strict=True)]
    number = {t: k + 1 for k, t in enumerate(sorted(set(tokens)))}
    # A separator after each span is smaller than all tokens.
    last = np.flatnonzero(after == ends)
    symbols = np.insert(np.fromiter(map(number.__getitem__, tokens), np.int64, len(tokens)), last + 1, 0)
    which = np.insert(np.arange(len(edges)), last + 1, -1)
    order = which[np.array(linear_suffix_array(symbols.tolist()), np.int64)]
    order = order[order >= 0]
    begin = edges[order]
    room = ends[order] - begin
    before = np.zeros(len(edges), np.int64)  # bytes of the token before, in the same span
    before[1:] = np.where(span[1:] == span[:-1], np.diff(edges), 0)
    tail = np.minimum(before[order], window - max(ahead, 1))
    shared = _shared(raw, begin, room, window)
    # The same from the suffixes' beginnings backwards, also beyond their tails.
    most = max(int(tail.max(initial=0)), 1)
    turned = raw[::-1]
    begin_back = len(raw) - begin
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate([turned, np.zeros(most, np.uint8)]), most)
    back = np.argsort(view[begin_back].view(f"S{most}").ravel(), kind="stable")
    shared_back = _shared(turned, begin_back[back], np.full(len(back), most), most)
    owner = span[order]
    for t in range(1, most + 1):
        near = tail >= t
        if 2 * np.count_nonzero(near) < len(near):  # the others have no more to say
            tail, room, begin, owner, shared = tail[near], room[near], begin[near], owner[near], _least(shared, near)
            still = near[back]
            shared_back, back = _least(shared_back, still), (np.cumsum(near) - 1)[back[still]]
            near = np.ones(len(tail), bool)
        some = np.flatnonzero(near & (room >= window - t))
        if not len(some):
            continue
        parts = np.cumsum(shared < window - t)  # suffixes that share the rest of the window
        heads = np.empty(len(back), np.int64)
        heads[back] = np.cumsum(shared_back < t)  # suffixes that share the t bytes before
        key = heads[some] * (len(back) + 1) + parts[some]
        _, same = np.unique(key, return_inverse=True)
        hit = begin[some][np.bincount(same, weight[owner[some]])[same] > 1.5] - t
        np.add.at(change, hit, 1)
        np.add.at(change, hit + window, -1)


def _least(shared: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """What each kept suffix shares with the kept one before it, given what each of all shares with the one before it."""
    place = np.flatnonzero(kept)
    if not len(place):
        return shared[:0]
    return np.minimum.reduceat(shared[: place[-1] + 1], np.concatenate([[0], place[:-1] + 1]))


def _shared(raw: np.ndarray, begin: np.ndarray, room: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in the order, up to `most` and the room of the shorter one."""
    out = np.zeros(len(begin), np.int64)
    padded = np.concatenate([raw, np.zeros(most, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(padded, most)
    for k in range(1, len(begin), 8192):
        b = begin[k : k + 8192]
        a = begin[k - 1 : k - 1 + len(b)]
        differ = view[a] != view[b]
        length = np.where(differ.any(axis=1), differ.argmax(axis=1), most)
        out[k : k + len(b)] = np.minimum(length, np.minimum(room[k - 1 : k - 1 + len(b)], room[k : k + len(b)]))
    return out


def remove_repeated_strings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 200, gram: int = 32) -> DataFrame:
    """Return id_col, n_bytes, n_removed, n_spans and kept (the bytes that stay) for every row."""

    def solve(contents: list[bytes], times: list[int], _: list) -> tuple[list[list[int]], list[list[int]]]:
        covers = repeated_windows(contents, times, window)
        return covers, covers

    return remove_repeats(docs, id_col, text_col, Unit(False, window, gram), solve, earlier=False).toDF(id_col, "n_bytes", "n_removed", "n_spans", "kept")

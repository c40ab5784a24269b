"""Finding what repeats between texts without comparing all with all: anchors, spans and shards.

A window is a run of `window` symbols (bytes or words) of one text. Its anchor is the rarest of its n-grams of
`gram` symbols, as a sketch of all counts tells, and among equals the one of the least hash, the first of them.
The anchor depends on the window's content alone, so equal windows have equal anchors. A span is what
neighbouring windows with the same anchor cover. Spans of anchors that occur once are left out. Of the others, equal spans are one class,
which is sent to the shard of its anchor once, with the number of its spans and the least of their ids.
A window stands in one span only. Thus whoever has all classes of an anchor can tell how often each of its windows occurs, and which id has it first:
a shard's suffix array or index decides that for every class. A passage that very many texts share has common anchors in
its inner windows only, whose spans are the same in each text, so that its classes stay few; windows on its edge
hold rarer n-grams. An anchor whose classes are too many for a shard all the same is parted by the next rarest n-gram of each of its windows.

Rows are known by 128 bits of hashes of id and text; anchors only bring spans together, and a class is an anchor, a length and 64 bits of its content's hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.llm.common import id_field, if_small, keyed, offsets_and_bytes, release, saved, small_batches
from alidade.llm.sketch import level_of, sketch_levels
from alidade.llm.words import byte_codes, content_hashes, rolling_hashes, word_hashes, word_spans

#: Windows that are handled at once, which bounds the memory for long texts.
SEGMENT = 1 << 20
#: Of these, windows whose anchors are looked for at once, so that the processor's cache holds them.
BLOCK = 1 << 15
PLACE_BITS = 22
#: Bytes of text for each n-gram that the sketch has a counter for.
GRAM_BYTES = {True: 64, False: 384}


@dataclass(frozen=True)
class Unit:
    """What windows count: bytes or words."""

    words: bool
    window: int
    gram: int

    def symbols(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]:
        """A code for each symbol, where each text's symbols begin, and for words their bytes' limits."""
        if not self.words:
            return byte_codes()[data], offsets, None, None
        starts, ends, first = word_spans(data, offsets)
        return word_hashes(data, starts, ends), first, starts, ends

    def grams(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Hashes of all n-grams within a text."""
        codes, first, _, _ = self.symbols(data, offsets)
        inside = _within(first, len(codes), self.gram)
        out = []
        for at in range(0, len(codes), BLOCK):
            hashes = rolling_hashes(codes[at : at + BLOCK + self.gram - 1], self.gram)
            out.append(hashes[inside[at : at + len(hashes)]])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _within(first: np.ndarray, n: int, size: int) -> np.ndarray:
    """Whether `size` symbols from here on are of one text."""
    change = np.zeros(n + 1, np.int32)
    length = np.diff(first)
    some = length >= size
    np.add.at(change, first[:-1][some], 1)
    np.add.at(change, first[:-1][some] + length[some] - size + 1, -1)
    return np.cumsum(change[:n]) > 0


def find_spans(codes: np.ndarray, first: np.ndarray, unit: Unit, levels: np.ndarray, without: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window and number of windows of each span.

    without: for each text an anchor that gives way to the next rarest n-gram, if the window has another.
    """
    window, gram = unit.window, unit.gram
    inside = _within(first, len(codes), window)
    anchors, begins, counts = [], [], []
    for at in range(0, len(codes), SEGMENT):
        part = codes[at : at + SEGMENT + window - 1]
        if len(part) < window:
            break
        n = len(part) - window + 1
        place = np.empty(n, np.int64)
        hashes = np.empty(n + window - gram, np.uint64)
        for low in range(0, n, BLOCK):
            some = rolling_hashes(part[low : min(low + BLOCK, n) + window - 1], gram)
            hashes[low : low + len(some)] = some
            key = level_of(some, levels).astype(np.uint64) << np.uint64(58)
            key |= (some >> np.uint64(28)) << np.uint64(PLACE_BITS)
            key |= np.arange(low, low + len(some), dtype=np.uint64)
            if without is not None:
                text = np.searchsorted(first, np.arange(at + low, at + low + len(some)), "right") - 1
                key[some == without[text]] |= np.uint64(63) << np.uint64(58)
            wide, reach = window - gram + 1, 1
            while reach * 2 <= wide:
                key = np.minimum(key[:-reach], key[reach:])
                reach *= 2
            here = min(BLOCK, n - low)
            best = np.minimum(key[:here], key[wide - reach : wide - reach + here])
            place[low : low + here] = best & np.uint64((1 << PLACE_BITS) - 1)
        starts = np.flatnonzero(inside[at : at + n])
        if not len(starts):
            continue
        place = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        edge = np.flatnonzero(new)
        anchors.append(hashes[place[edge]])
        begins.append(starts[edge] + at)
        counts.append(np.diff(np.append(edge, len(starts))))
    if not anchors:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(anchors), np.concatenate(begins), np.concatenate(counts)


#: Given contents, numbers of spans and least ids of classes: the limits, in symbols, of the covered parts of each class
#: in texts with its least id, and in texts with later ids.
Solver = Callable[[list[bytes], list[int], list], tuple[list[list[int]], list[list[int]]]]


def remove_repeats(docs: DataFrame, id_col: str, text_col: str, unit: Unit, solve: Solver, earlier: bool, shard_bytes: int = 1 << 20, anchor_bytes: int = 16 << 20) -> DataFrame:
    """Return id, n, removed, runs and kept (the bytes that stay) for every row.

    A window is repeated if it occurs elsewhere or, with earlier, if it occurs in a text with a smaller id.
    With earlier, rows without an id neither lose nor take anything.
    A shard holds the classes of whole anchors, about shard_bytes of them; an anchor of more than anchor_bytes is parted.
    """
    base = keyed(docs, id_col, text_col).withColumns({"r": F.xxhash64("id", "text"), "r2": F.xxhash64(F.lit(1), "text", "id")})
    levels = sketch_levels(base, unit.grams, GRAM_BYTES[unit.words])
    cell = base.sparkSession.sparkContext.broadcast(levels)
    id_kind = id_field(docs, id_col)
    window = unit.window
    names = ["anchor", "span", "r", "r2", "id", "start", "count"]

    def anchors_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            offsets, data = offsets_and_bytes(batch.column("text"))
            codes, first, _, _ = unit.symbols(data, offsets)
            anchors, begin, _ = find_spans(codes, first, unit, cell.value)
            columns = [pa.array(anchors.view(np.int64))]
            if earlier:
                columns.append(batch.column("id").take(pa.array(np.searchsorted(first, begin, "right") - 1)))
            yield pa.RecordBatch.from_arrays(columns, ["anchor", "id"][: len(columns)])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            offsets, data = offsets_and_bytes(batch.column("text"))
            codes, first, starts, ends = unit.symbols(data, offsets)
            anchors, begin, count = find_spans(codes, first, unit, cell.value)
            text = np.searchsorted(first, begin, "right") - 1
            spans = _span_hashes(data, starts, ends, begin, begin + count + window - 1)
            taken = pa.array(text)
            columns = [pa.array(anchors.view(np.int64)), pa.array(spans.view(np.int64)), *(batch.column(c).take(taken) for c in ("r", "r2", "id"))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array((begin - first[text]).astype(np.int64)), pa.array(count.astype(np.int32))], names)

    longs = {c: T.StructField(c, T.LongType()) for c in ("anchor", "span", "r", "r2", "start", "times")}
    emitted = T.StructType([longs["anchor"], longs["span"], longs["r"], longs["r2"], id_kind, longs["start"], T.StructField("count", T.IntegerType())])
    texts = base.where("id is not null") if earlier else base
    spans = texts.mapInArrow(emit, emitted)
    if earlier:
        twice = texts.select("id", "text").mapInArrow(anchors_only, T.StructType([longs["anchor"], id_kind])).groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    else:
        twice = texts.select("text").mapInArrow(anchors_only, T.StructType([longs["anchor"]])).groupBy("anchor").agg(F.count("*").alias("times")).where("times > 1").select("anchor")
    # Written first, so that either this side is broadcast or the join may split the rows of a hot anchor.
    anchors = saved(twice, "repeat-anchors")
    spans = saved(spans.join(if_small(anchors), "anchor", "left_semi"), "repeat-spans")
    release(anchors)
    one = F.min(F.struct("r", "r2", "start")).alias("one")
    classes = spans.groupBy("anchor", "span", "count").agg(F.count("*").alias("times"), F.min("id").alias("least"), one).select("*", "one.r", "one.r2", "one.start").drop("one")
    classes = saved(classes, "repeat-classes")
    wanted = classes.groupBy("r", "r2").agg(F.collect_list(F.struct("anchor", "span", "start", "count", "times", "least")).alias("asked"))  # no more than a text has spans
    part = T.StructType([longs["anchor"], T.StructField("of", T.LongType()), longs["span"], T.StructField("count", T.IntegerType()), T.StructField("at", T.IntegerType()),
                         longs["times"], id_field(docs, id_col, "least"), T.StructField("content", T.BinaryType())])

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            offsets, data = offsets_and_bytes(batch.column("text"))
            _, first, starts, ends = unit.symbols(data, offsets)
            asked = batch.column("asked")
            text = np.repeat(np.arange(batch.num_rows), np.diff(np.asarray(asked.offsets)))
            each = asked.flatten()
            begin = np.asarray(each.field("start")) + first[text]
            end = begin + np.asarray(each.field("count")) + window - 1
            if unit.words:
                begin, end = starts[begin], ends[end - 1]
            raw = data.tobytes()
            contents = [raw[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
            anchor, span, count, times, least = (each.field(c) for c in ("anchor", "span", "count", "times", "least"))
            yield pa.RecordBatch.from_arrays([anchor, anchor, span, count, pa.array(np.zeros(len(contents), np.int32)), times, least, pa.array(contents, pa.binary())], part.names)

    def reanchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = offsets_and_bytes(batch.column("content"))
            codes, first, starts, ends = unit.symbols(data, offsets)
            anchors, begin, count = find_spans(codes, first, unit, cell.value, np.asarray(batch.column("anchor")).view(np.uint64))
            text = np.searchsorted(first, begin, "right") - 1
            at, end = begin - first[text], begin + count + window - 1
            if unit.words:
                begin, end = starts[begin], ends[end - 1]
            raw, taken = data.tobytes(), pa.array(text)
            contents = [raw[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True)]
            both = (anchors ^ (np.asarray(batch.column("anchor"))[text].view(np.uint64) >> np.uint64(1))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(both), *(batch.column(c).take(taken) for c in ("of", "span", "count")), pa.array(at.astype(np.int32)),
                                              *(batch.column(c).take(taken) for c in ("times", "least")), pa.array(contents, pa.binary())], part.names)

    limits = T.ArrayType(T.IntegerType())
    cover = T.StructType([T.StructField("of", T.LongType()), longs["span"], T.StructField("count", T.IntegerType()), T.StructField("first", limits), T.StructField("later", limits)])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None

        def solved() -> pa.RecordBatch:
            of, span, count, at, times, least, contents = zip(*held, strict=True)
            covers = [[[x + a for x in c] for c, a in zip(some, at, strict=True)] for some in solve(list(contents), list(times), list(least))]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(span, pa.int64()), pa.array(count, pa.int32()), *(pa.array(c, pa.list_(pa.int32())) for c in covers)], cover.names)

        for batch in batches:
            for anchor, *row in zip(*(batch.column(c).to_pylist() for c in ("anchor", "of", "span", "count", "at", "times", "least", "content")), strict=True):
                if anchor != last and size >= shard_bytes:  # all classes of an anchor stay together
                    yield solved()
                    size = 0
                last = anchor
                held.append(tuple(row))
                size += len(row[-1])
        if held:
            yield solved()

    asked = base.join(if_small(saved(wanted.select("r", "r2"), "repeat-asked")), ["r", "r2"], "left_semi").join(wanted, ["r", "r2"])
    contents = saved(asked.select("text", "asked").mapInArrow(fetch, part), "repeat-contents")
    hot = saved(contents.groupBy("anchor").agg(F.sum(F.length("content")).alias("bytes"), F.count("*").alias("n")).where(f"bytes > {anchor_bytes} and n > 1").select("anchor"), "repeat-hot")
    parts = [contents.join(F.broadcast(hot), "anchor", "left_anti"), contents.join(F.broadcast(hot), "anchor", "left_semi").select(part.names).mapInArrow(reanchored, part)] if hot.limit(1).count() else [contents]
    dealt = parts[0].select(part.names) if len(parts) == 1 else parts[0].select(part.names).union(parts[1])
    covers = saved(dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(shard, cover).withColumnRenamed("of", "anchor"), "repeat-covers")
    release(contents, hot)
    # Written first, so that the join may split the rows of a hot class.
    found = saved(covers.join(classes.select("anchor", "span", "count", "least"), ["anchor", "span", "count"]), "repeat-found")
    release(covers, classes)
    hit = spans.join(found, ["anchor", "span", "count"])
    parts = hit.select("r", "r2", "start", F.when(F.col("id") > F.col("least"), F.col("later")).otherwise(F.col("first")).alias("cover")).where(F.size("cover") > 0)
    cuts = parts.groupBy("r", "r2").agg(F.collect_list(F.struct("start", "cover")).alias("cuts"))  # no more than a text has spans
    out = T.StructType([id_kind, T.StructField("n", T.LongType()), T.StructField("removed", T.LongType()), T.StructField("runs", T.LongType()), T.StructField("kept", T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            if not unit.words:
                yield _bytes_cut(batch, out.names)
                continue
            rows = []
            for text, cuts_of in zip(batch.column("text").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
                limits = [(c["start"] + a, c["start"] + z) for c in cuts_of or () for a, z in zip(c["cover"][::2], c["cover"][1::2], strict=True)]
                rows.append(_without(text, limits))
            n, removed, runs, kept = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(x, pa.int64()) for x in (n, removed, runs)), pa.array(kept, pa.binary())], out.names)

    cuttable = base.where("id is not null") if earlier else base
    done = cuttable.join(cuts, ["r", "r2"], "left").select("id", "text", "cuts")
    if earlier:
        done = done.union(base.where("id is null").select("id", "text", F.lit(None).cast(cuts.schema["cuts"].dataType)))
    return done.mapInArrow(cut, out)


def _span_hashes(data: np.ndarray, starts: np.ndarray | None, ends: np.ndarray | None, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span's content; words are joined by one space."""
    if starts is not None:
        lengths = ends - starts + 1
        limits = np.concatenate([[0], np.cumsum(lengths)])
        place = np.arange(limits[-1]) + np.repeat(starts - limits[:-1], lengths)
        data = np.append(data, np.uint8(32))[place]
        data[limits[1:] - 1] = 32
        begin, end = limits[begin], limits[end] - 1
    return content_hashes(data.tobytes(), begin.tolist(), end.tolist())


def _bytes_cut(batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """Number of bytes, of removed ones and of runs of these, and what is left, for texts with their cuts."""
    offsets, data = offsets_and_bytes(batch.column("text"))
    cuts = batch.column("cuts")
    text = np.repeat(np.arange(batch.num_rows), np.asarray(cuts.value_lengths().fill_null(0)))
    each = cuts.flatten()
    cover = each.field("cover")
    of = np.repeat(np.arange(len(each)), np.asarray(cover.value_lengths().fill_null(0)) // 2)
    limits = np.asarray(cover.flatten()).reshape(-1, 2) + (offsets[text] + np.asarray(each.field("start")))[of][:, None]
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, limits[:, 0], 1)
    np.add.at(change, limits[:, 1], -1)
    gone = np.cumsum(change[:-1]) > 0
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    begins[heads] = gone[heads]
    removed, runs = (np.concatenate([[0], np.cumsum(x)])[offsets] for x in (gone, begins))
    kept = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((offsets - removed).astype(np.int32)), pa.py_buffer(data[~gone])])
    return pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(np.diff(x)) for x in (offsets, removed, runs)), kept], names)


def _without(text: bytes, limits: list[tuple[int, int]]) -> tuple[int, int, int, bytes]:
    """Number of words, of removed ones and of runs of these, and what is left."""
    units = text.split()
    runs: list[list[int]] = []
    for a, z in sorted(limits):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], z)
        else:
            runs.append([a, z])
    edges = [0, *(x for run in runs for x in run), len(units)]
    kept = [units[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True)]
    return len(units), sum(z - a for a, z in runs), len(runs), b" ".join([w for part in kept for w in part])

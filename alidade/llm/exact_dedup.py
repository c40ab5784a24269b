"""Exact dedup by Grace hash partitioning: spill files by hash, then open addressing on whole contents.

Defined results: null counts as empty text; texts are equal when identical after lower-casing A-Z;
of equal rows the largest id stays (null ids are the smallest), and of several rows with that id one;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import struct
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.llm.common import keyed, saved

#: Bits of the hash that one level of partitioning uses, and so 64 / FAN_BITS levels at most.
FAN_BITS = 4
_HEAD = struct.Struct("<QqI")


class OpenTable:
    """Open addressing with linear probing; equality is of complete contents, never of hashes."""

    def __init__(self, slots: int = 1024) -> None:
        self.slots = [-1] * slots
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.size = 0

    def find(self, code: int, content: bytes) -> int:
        """The entry of this content, made if there is none."""
        if len(self.hashes) * 2 >= len(self.slots):
            self._grow()
        mask = len(self.slots) - 1
        at = code & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == code and self.contents[entry] == content:
                return entry
            at = (at + 1) & mask
        self.slots[at] = entry = len(self.hashes)
        self.hashes.append(code)
        self.contents.append(content)
        self.size += len(content) + 120
        return entry

    def _grow(self) -> None:
        self.slots = [-1] * (len(self.slots) * 4)
        mask = len(self.slots) - 1
        for entry, code in enumerate(self.hashes):
            at = code & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def grace_groups(records: Iterable[tuple[int, int, bytes]], budget: int, level: int = 0) -> Iterator[tuple[bytes, list[int]]]:
    """Yield (content, row numbers) of each distinct content among (hash, row number, content).

    A table takes records until its distinct contents pass the budget. Then records of new contents go
    to spill files by the next bits of their hash, and each file is grouped the same way. Copies of
    a content that the table holds are added there, so copies alone never cause a spill. When the bits
    of the hash are used up, the rest stays in one table.
    """
    table, members = OpenTable(), []
    fan, last = 1 << FAN_BITS, (level + 1) * FAN_BITS > 64
    with tempfile.TemporaryDirectory(prefix="grace-") as folder:
        files: list = []
        for code, row, content in records:
            if table.size < budget or last:
                entry = table.find(code, content)
                if entry == len(members):
                    members.append([])
                members[entry].append(row)
                continue
            entry = _lookup(table, code, content)
            if entry >= 0:
                members[entry].append(row)
                continue
            files = files or [open(os.path.join(folder, str(k)), "wb") for k in range(fan)]  # noqa: SIM115
            out = files[(code >> (60 - level * FAN_BITS)) & (fan - 1)]
            out.write(_HEAD.pack(code, row, len(content)))
            out.write(content)
        yield from zip(table.contents, members, strict=True)
        del table, members
        for out in files:
            out.close()
            if os.path.getsize(out.name):
                yield from grace_groups(_spilled(out.name), budget, level + 1)
            os.remove(out.name)


def _lookup(table: OpenTable, code: int, content: bytes) -> int:
    mask = len(table.slots) - 1
    at = code & mask
    while (entry := table.slots[at]) >= 0:
        if table.hashes[entry] == code and table.contents[entry] == content:
            return entry
        at = (at + 1) & mask
    return -1


def _spilled(path: str) -> Iterator[tuple[int, int, bytes]]:
    with open(path, "rb") as lines:
        while head := lines.read(_HEAD.size):
            code, row, size = _HEAD.unpack(head)
            yield code, row, lines.read(size)


def _key(value):  # noqa: ANN001, ANN202
    """Order of ids with null as the smallest; a struct is ordered by its fields."""
    return (value is not None, tuple(_key(v) for v in value.values()) if isinstance(value, dict) else value)


def _sliced(rows: Iterable[list], schema: pa.Schema, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of about limit bytes from rows; the last field of the schema is the content."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + len(row[-1] or b"")
        if size >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = 64 << 20) -> DataFrame:
    """Return id_col, keep_id, group_size, kept and content_sha256 (of the normalised text) for every row.

    Each task first groups its own rows, so that a group of copies sends one content a task. These
    contents are then dealt by hash and grouped again. Rows find their group through the local one, so
    the last join has no key with more rows than one input partition has. Grouping holds `budget` bytes of distinct
    contents; what is beyond goes to the task's own spill files, which a lost task's rerun writes anew.
    """
    kind = docs.schema[id_col].dataType
    first = T.StructType([T.StructField("row", T.LongType()), T.StructField("local", T.LongType()), T.StructField("id", kind), T.StructField("top", kind), T.StructField("top_row", T.LongType()),
                          T.StructField("n", T.LongType()), T.StructField("code", T.LongType()), T.StructField("content", T.BinaryType())])

    def local_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        kinds: list[pa.DataType] = []
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36

        def records() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                if not kinds:
                    kinds.append(batch.schema.field("id").type)
                for key, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    content = text.lower()  # of bytes: A-Z only
                    ids.append(key)
                    yield xxhash.xxh3_64_intdigest(content), len(ids) - 1, content

        def rows() -> Iterator[list]:
            for content, members in grace_groups(records(), budget):
                code = xxhash.xxh3_64_intdigest(content) - (1 << 63)
                best = max(members, key=lambda m: (_key(ids[m]), -m))
                for k, m in enumerate(members):
                    yield [base + m, base + members[0], ids[m], ids[best], base + best, len(members), code, content if k == 0 else None]

        it = rows()
        head = next(it, None)
        if head is None:
            return
        out = pa.schema([("row", pa.int64()), ("local", pa.int64()), ("id", kinds[0]), ("top", kinds[0]), ("top_row", pa.int64()), ("n", pa.int64()), ("code", pa.int64()), ("content", pa.binary())])

        def chained() -> Iterator[list]:
            yield head
            yield from it

        yield from _sliced(chained(), out)

    rows = saved(keyed(docs, id_col, text_col).mapInArrow(local_groups, first), "exact-local")
    second = T.StructType([T.StructField("local", T.LongType()), T.StructField("keep_id", kind), T.StructField("keep_row", T.LongType()),
                           T.StructField("group_size", T.LongType()), T.StructField("sha", T.BinaryType())])

    def all_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        locals_, tops, rows_of, counts = [], [], [], []
        kinds: list[pa.DataType] = []

        def records() -> Iterator[tuple[int, int, bytes]]:
            for batch in batches:
                if not kinds:
                    kinds.append(batch.schema.field("top").type)
                columns = (batch.column(c).to_pylist() for c in ("local", "top", "top_row", "n", "code", "content"))
                for local, top, top_row, n, code, content in zip(*columns, strict=True):
                    locals_.append(local)
                    tops.append(top)
                    rows_of.append(top_row)
                    counts.append(n)
                    yield code + (1 << 63), len(locals_) - 1, content

        def rows() -> Iterator[list]:
            for content, members in grace_groups(records(), budget):
                best, size = max(members, key=lambda m: (_key(tops[m]), -rows_of[m])), sum(counts[m] for m in members)
                sha = hashlib.sha256(content).digest()
                for m in members:
                    yield [locals_[m], tops[best], rows_of[best], size, sha]

        it = rows()
        head = next(it, None)
        if head is None:
            return

        def chained() -> Iterator[list]:
            yield head
            yield from it

        yield from _sliced(chained(), pa.schema([("local", pa.int64()), ("keep_id", kinds[0]), ("keep_row", pa.int64()), ("group_size", pa.int64()), ("sha", pa.binary())]))

    groups = rows.filter("content is not null").select("local", "top", "top_row", "n", "code", "content").repartition("code").mapInArrow(all_groups, second)
    return rows.select("row", "local", "id").join(groups, "local").select(
        F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("content_sha256")
    )

"""A sketch of how often hashes occur in all texts: it only orders and weighs, and never decides a result."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.llm.common import offsets_and_bytes, small_batches

#: Binary logarithm of the number of counters, which follows the input between these. A counter is broadcast as one byte, so 16 MB are the most.
LEAST_BITS, MOST_BITS = 18, 24
#: Counters that are summed together. A task sends each such part once, and parts are summed as their rows stream by.
PART_BITS = 16
#: Levels are twice the binary logarithm of a count, and this at most.
MOST_LEVEL = 63


def sketch_bits(texts: DataFrame, bytes_a_hash: int) -> int:
    """About one counter for each hash that is counted, as far as the limits allow."""
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(max(int(size // bytes_a_hash).bit_length(), LEAST_BITS), MOST_BITS)


def sketch_levels(texts: DataFrame, hashes: Callable[[np.ndarray, np.ndarray], np.ndarray], bytes_a_hash: int) -> np.ndarray:
    """Counts of all hashes of all texts, as rounded twice their binary logarithm, by the hash's leading bits.

    bytes_a_hash: how many bytes of text there are for a hash. Each task sends its counters compressed, in parts.
    """
    bits = sketch_bits(texts, bytes_a_hash)
    parts, width = 1 << (bits - PART_BITS), 1 << PART_BITS
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("counts", T.BinaryType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint32)
        for batch in small_batches(batches):
            found = hashes(*reversed(offsets_and_bytes(batch.column("text"))))
            np.add.at(total, (found >> np.uint64(64 - bits)).astype(np.int64), np.uint32(1))
        for k in range(parts if total.any() else 0):
            packed = zlib.compress(total[k * width : (k + 1) * width].tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([packed], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums.setdefault(part, np.zeros(width, np.uint64))
                sums[part] += np.frombuffer(zlib.decompress(counts), np.uint32)
        levels = [np.minimum(np.round(2 * np.log2(np.maximum(c, 1).astype(float))), MOST_LEVEL).astype(np.uint8).tobytes() for c in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(levels, pa.binary())], ["part", "counts"])

    out = np.zeros(1 << bits, np.uint8)
    for row in texts.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # one byte a counter
        out[row.part * width : (row.part + 1) * width] = np.frombuffer(row.counts, np.uint8)
    return out


def noise_level(levels: np.ndarray) -> float:
    """What a counter holds of other hashes: the mean, as most hashes are rare."""
    return float(np.mean(2.0 ** (levels[levels > 0] / 2.0))) if (levels > 0).any() else 0.0


def level_of(hashes: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return levels[(hashes >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]

"""Byte-level BPE: encode whole texts by a local rank file with tiktoken, decode ids to raw bytes.

Defined results: a null or empty text has no ids and decodes to no bytes; bytes that are not UTF-8
are read as U+FFFD before encoding; repeated rows and ids are encoded row by row; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from alidade.llm.common import id_field, keyed, small_batches

#: A cut after such a character never changes the matches of the pattern: no match holds white space
#: after another character, and none goes on from a letter to a digit. Nothing looks back.
SAFE_CUT = re.compile(r"\S(?=[ \n])|[A-Za-z](?=[0-9])")


@functools.cache
def encoding(rank_path: str, pattern: str) -> tuple[tiktoken.Encoding, list[bytes]]:
    """The encoder and each id's bytes; once per Python worker."""
    with open(rank_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, lines.read().splitlines()))}
    by_id = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        by_id[rank] = token
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), by_id


def pieces(text: str, chunk_chars: int) -> Iterator[str]:
    """Parts of about chunk_chars, cut only at safe places; a text without any stays whole."""
    start = 0
    while len(text) - start > chunk_chars:
        cut = SAFE_CUT.search(text, start + chunk_chars - 1)
        if cut is None:
            break
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def encode_text(text: str, enc: tiktoken.Encoding, chunk_chars: int) -> np.ndarray:
    return np.concatenate([enc.encode_to_numpy(part, disallowed_special=()) for part in pieces(text, chunk_chars)]).astype("<u4")


def decode_ids(ids: np.ndarray, by_id: list[bytes]) -> bytes:
    """Raw bytes, whether or not they are UTF-8."""
    return b"".join([by_id[i] for i in ids.tolist()])


def bpe_round_trip(
    docs: DataFrame, rank_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = 100_000
) -> DataFrame:
    """Return id_col, ids (packed little-endian unsigned 32-bit) and decoded (raw bytes) for every row.

    rank_path must exist on each node. One pass, no shuffle; memory is bounded by a batch or one text.
    """
    name = id_col
    schema = T.StructType([id_field(docs, id_col, name), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, by_id = encoding(rank_path, pattern)
        for batch in small_batches(batches):
            packed, decoded = [], []
            for text in batch.column("text").to_pylist():
                ids = encode_text(text.decode("utf-8", "replace"), enc, chunk_chars)
                packed.append(ids.tobytes())
                decoded.append(decode_ids(ids, by_id))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary()), pa.array(decoded, pa.binary())], [name, "ids", "decoded"])

    return keyed(docs, id_col, text_col).mapInArrow(run, schema)

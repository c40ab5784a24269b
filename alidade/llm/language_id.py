"""Language ID: a convolutional network over bytes, trained in numpy and applied to fixed-length windows.

Bytes are embedded, filters of several widths run over the window, each filter's maximum is taken, and a
softmax layer gives the languages. As filters are linear in the bytes they see, a trained network is
folded into tables of the filters' answers to single bytes and pairs of bytes, which are added up.

Defined results: null text, or text without a letter, is `und` with score 0; a long text is cut into windows
that together cover all of it, and their log probabilities are averaged by bytes; repeated rows
are judged row by row; an empty table gives an empty one; other columns are ignored; without labelled
rows every text is `und`.
"""

from __future__ import annotations

import collections
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.llm.common import id_field, keyed, map_texts, offsets_and_bytes

UNKNOWN = "und"
WIDTHS = (2, 3, 4)
LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteNet:
    """Parameters; filters[k] is width x embedding x filters."""

    langs: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]
    biases: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.embedding, *self.filters, *self.biases, self.out, self.out_bias]


def new_net(langs: list[str], dims: int = 8, filters: int = 12, seed: int = 11) -> ByteNet:
    rng = np.random.default_rng(seed)
    kernels = [rng.normal(0, 1 / np.sqrt(w * dims), (w, dims, filters)).astype(np.float32) for w in WIDTHS]
    biases = [np.zeros(filters, np.float32) for _ in WIDTHS]
    out = rng.normal(0, 0.1, (filters * len(WIDTHS), len(langs))).astype(np.float32)
    return ByteNet(langs, rng.normal(0, 1, (256, dims)).astype(np.float32), kernels, biases, out, np.zeros(len(langs), np.float32))


def _learn_step(net: ByteNet, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss and gradients of a batch of windows x (bytes) with labels y."""
    e = net.embedding[x]
    n, size, dims = e.shape
    pooled, at, columns = [], [], []
    for kernel, bias in zip(net.filters, net.biases, strict=True):
        width = len(kernel)
        seen = np.concatenate([e[:, j : size - width + 1 + j] for j in range(width)], axis=2)
        z = seen @ kernel.reshape(width * dims, -1) + bias
        best = z.argmax(axis=1)
        columns.append(seen)
        at.append(best)
        pooled.append(np.take_along_axis(z, best[:, None], 1)[:, 0])
    h = np.maximum(np.concatenate(pooled, axis=1), 0)
    logits = h @ net.out + net.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    p /= p.sum(axis=1, keepdims=True)
    loss = float(-np.log(p[np.arange(n), y] + 1e-12).mean())
    p[np.arange(n), y] -= 1
    p /= n
    g_h = (p @ net.out.T) * (h > 0)
    g_e = np.zeros_like(net.embedding)
    g_kernels, g_biases, k0 = [], [], 0
    rows = np.arange(n)[:, None]
    for kernel, seen, best in zip(net.filters, columns, at, strict=True):
        width, _, count = kernel.shape
        g = g_h[:, k0 : k0 + count]
        k0 += count
        picked = seen[rows, best]  # window x filter x (width * dims)
        g_kernels.append(np.einsum("nf,nfd->df", g, picked).reshape(kernel.shape))
        g_biases.append(g.sum(axis=0))
        back = g[:, :, None] * kernel.reshape(width * dims, count).T[None]
        for j in range(width):
            np.add.at(g_e, x[rows, best + j], back[:, :, j * dims : (j + 1) * dims])
    return loss, [g_e, *g_kernels, *g_biases, h.T @ p, p.sum(axis=0)]


def train_net(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 5) -> ByteNet:
    """Adam on shuffled batches; windows is n x length of bytes."""
    net, rng = new_net(langs), np.random.default_rng(seed)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parts()]
    turn = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // batch)):
            turn += 1
            _, grads = _learn_step(net, windows[rows], labels[rows])
            for p, g, (m, v) in zip(net.parts(), grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= rate * 0.5**epoch * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.99**turn)) + 1e-7)
    return net


class Folded:
    """The network as tables: each filter's answer to a byte, or to a pair of bytes, at a place."""

    def __init__(self, net: ByteNet) -> None:
        self.net = net
        self.tables: list[list[tuple[int, bool, np.ndarray]]] = []
        for kernel, bias in zip(net.filters, net.biases, strict=True):
            single = [net.embedding @ k for k in kernel]
            single[0] = single[0] + bias
            pairs = [(j, True, (single[j][:, None] + single[j + 1][None]).reshape(1 << 16, -1)) for j in range(0, len(single) - 1, 2)]
            odd = [(len(single) - 1, False, single[-1])] if len(single) % 2 else []
            self.tables.append(pairs + odd)

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        """windows: n x length of bytes."""
        size, pooled = windows.shape[1], []
        pairs = windows[:, :-1].astype(np.int32) << 8 | windows[:, 1:]
        for kernel, tables in zip(self.net.filters, self.tables, strict=True):
            steps, z = size - len(kernel) + 1, None
            for j, pair, answers in tables:
                got = answers.take((pairs if pair else windows)[:, j : j + steps], axis=0)
                z = got if z is None else np.add(z, got, out=z)
            pooled.append(z.max(axis=1))
        logits = np.maximum(np.concatenate(pooled, axis=1), 0) @ self.net.out + self.net.out_bias
        logits -= logits.max(axis=1, keepdims=True)
        return logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))


def cut_windows(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as windows of `size` bytes, the last of a text filled with 0: windows, their text, their bytes."""
    lengths = np.diff(offsets)
    count = -(-lengths // size)
    text_of = np.repeat(np.arange(len(lengths)), count)
    number = np.arange(len(text_of)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[:-1][text_of] + number * size
    used = np.minimum(size, offsets[1:][text_of] - start)
    padded = np.concatenate([data, np.zeros(size, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, size)[start] if len(start) else np.zeros((0, size), np.uint8)
    out = out.copy()
    short = np.flatnonzero(used < size)
    for k in short.tolist():
        out[k, used[k] :] = 0
    return out, text_of, used


def share_rows(counts: dict[str, int], most: int) -> dict[str, tuple[int, int]]:
    """For each language the rows to take, alike as far as there are rows and one at least, and the rows it has."""
    out, left = {}, most
    for k, (lang, count) in enumerate(sorted(counts.items(), key=lambda c: (c[1], c[0]))):
        take = max(1, min(count, left // (len(counts) - k)))
        out[lang] = (take, count)
        left -= take
    return out


def learn_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_docs: int = 4000, windows_a_doc: int = 3, size: int = 128) -> ByteNet | None:
    """Train on windows of at most most_docs rows, or one row of each language; rows with crc32(id) mod 4 = 2 are held out.

    Languages share most_docs alike, and what a rare one leaves goes to the others; of each language, rows are taken by the order of a hash of
    the id. windows_a_doc windows spread evenly over each of these rows are used, and its beginning once more, shortened, so that short texts are known too.
    """
    code = F.crc32(F.col(id_col).cast("string"))
    rows = docs.filter(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (code % 4 != 2))
    takes = share_rows({r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}, most_docs)
    if not takes:
        return None
    # Hashes are even, so a bound on them leaves about twice the rows that are taken; the least of these are the least of all.
    bounds = rows.sparkSession.createDataFrame([(lang, min(1.0, 2 * (take + 50) / count)) for lang, (take, count) in takes.items()], "lang string, bound double")
    spread = [F.substring("bytes", F.expr(f"int(1 + (length(bytes) - {size}) * {k}L div {max(windows_a_doc - 1, 1)})"), F.lit(size)) for k in range(windows_a_doc)]
    # Texts are cut to the windows before they meet.
    cut = F.when(F.length("bytes") <= windows_a_doc * size, F.col("bytes")).otherwise(F.concat(*spread)).alias("text")
    hashed = rows.select(F.xxhash64(F.col(id_col)).alias("h"), F.col(lang_col).cast("string").alias("lang"), F.encode(text_col, "UTF-8").alias("bytes"))
    found = hashed.join(F.broadcast(bounds), "lang").where(F.col("h") / F.lit(2.0**64) + 0.5 <= F.col("bound")).select("h", "lang", cut).collect()
    part, taken = [], collections.Counter()
    for r in sorted(found, key=lambda r: (r.h, r.lang, bytes(r.text))):
        if taken[r.lang] < takes[r.lang][0]:
            taken[r.lang] += 1
            part.append(r)
    langs = sorted({r.lang for r in part})
    if not langs:
        return None
    texts = [bytes(r.text) for r in part]
    short = [t[: 6 + 11 * (k % 6)] for k, t in enumerate(texts)]
    data = np.frombuffer(b"".join(texts + short), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts + short])])
    windows, text_of, _ = cut_windows(data, offsets, size)
    labels = np.array([langs.index(r.lang) for r in part] * 2)[text_of]
    return train_net(windows, labels, langs)


def identify_languages(docs: DataFrame, net: ByteNet | None, id_col: str = "doc_id", text_col: str = "text", size: int = 128) -> DataFrame:
    """Return id_col, lang_pred and score (its probability) for every row, in one pass without shuffle.

    Windows are scored 256 at a time, so memory does not grow with the length of a text.
    """
    schema = T.StructType([id_field(docs, id_col, id_col), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    folded: list[Folded] = []

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, data = offsets_and_bytes(batch.column("text"))
        n = batch.num_rows
        known = np.zeros(n, bool)
        if net is not None:
            known = np.array([LETTER.search(t.decode("utf-8", "replace")) is not None for t in batch.column("text").to_pylist()], bool)
        names, score = np.full(n, UNKNOWN, object), np.zeros(n)
        if known.any():
            if not folded:
                folded.append(Folded(net))
            windows, text_of, used = cut_windows(data, offsets, size)
            total = np.zeros((n, len(net.langs)))
            for k in range(0, len(windows), 256):
                part = slice(k, k + 256)
                np.add.at(total, text_of[part], folded[0].log_probabilities(windows[part]) * used[part, None])
            mean = total / np.maximum(np.diff(offsets), 1)[:, None]
            p = np.exp(mean - mean.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = p.argmax(axis=1)
            names[known] = np.array(net.langs, object)[best[known]]
            score[known] = p[np.arange(n), best][known]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(names.tolist(), pa.string()), pa.array(score)], schema.names)

    return map_texts(keyed(docs, id_col, text_col), judged, schema)

"""Quality rules: a linear-chain conditional random field labels lines; the content share decides.

A line is described by binary features of its bytes. The field has two labels, content and boilerplate,
a weight for each label and feature and one for each pair of neighbouring labels. It is trained in numpy
by full-batch ascent of the conditional likelihood, on labels of lines that are drawn from what the lines alone speak for and
from the verdict on their text. Viterbi decoding gives the best label sequence of a text.

Defined results: a null or empty text is one empty line: all counts 0, base_failed true, kept false;
a text of any length is read whole; words are parted by the bytes 9 to 13 and 32; repeated rows and ids are
judged row by row; an empty table gives an empty one; other columns are ignored. Without labelled
rows of both kinds the field has weight 0 everywhere, and ties decode as content.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.llm.common import id_field, keyed, map_texts, offsets_and_bytes
from alidade.llm.words import SPACE, content_hashes, gram_hashes, mix, word_hashes, word_spans

CONTENT, BOILERPLATE = 0, 1
#: Characters of n_symbols.
SYMBOLS = b"#*$%&|<>"
#: Upper limits of the bins of each measured share or count of a line.
BINS = {
    "words": (0, 1, 2, 4, 8, 16, 64),
    "symbol_share": (0.0, 0.01, 0.05, 0.15),
    "letter_share": (0.5, 0.7, 0.8, 0.9),
    "digit_share": (0.0, 0.05, 0.2),
    "upper_share": (0.02, 0.1, 0.3, 0.6),
    "word_bytes": (3.0, 4.5, 6.0, 7.5, 9.0),
    "distinct_share": (0.2, 0.4, 0.6, 0.8),
}
N_FEATURES = sum(len(b) + 1 for b in BINS.values()) + 4


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_SYMBOL, _DIGIT, _UPPER, _END = _flags(SYMBOLS), _flags(b"0123456789"), _flags(bytes(range(65, 91))), _flags(b".!?:;\"'")


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key occurs twice or more, and whether it occurred before."""
    order = np.argsort(keys, kind="stable")
    same = np.zeros(len(keys), bool)
    same[1:] = keys[order[1:]] == keys[order[:-1]]
    both = same.copy()
    both[:-1] |= same[1:]
    twice, before = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    twice[order], before[order] = both, same
    return twice, before


@dataclass
class Lines:
    """All lines of a batch of texts; those of text t are first[t] to first[t + 1]."""

    first: np.ndarray
    codes: np.ndarray  # one bit a feature
    words: np.ndarray
    counts: dict[str, np.ndarray]  # by text


def describe(data: np.ndarray, offsets: np.ndarray) -> Lines:
    """Features of the lines and counts of the texts."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    text_of = np.concatenate([np.arange(n), np.searchsorted(offsets, breaks, "right") - 1])
    starts = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((starts, text_of))
    starts, text_of = starts[order], text_of[order]
    first = np.searchsorted(text_of, np.arange(n + 1))
    ends = np.empty_like(starts)
    ends[:-1] = starts[1:] - 1
    ends[first[1:] - 1] = offsets[1:]
    w_starts, w_ends, w_first = word_spans(data, offsets)
    hashes = word_hashes(data, w_starts, w_ends)
    l_first, l_last = np.searchsorted(w_starts, starts), np.searchsorted(w_starts, ends)
    words = l_last - l_first
    # Distinct words of a line: those that did not occur before in it.
    line_of = np.repeat(np.arange(len(starts)), words)
    new_word = _sums(~_repeated(mix(hashes ^ mix(line_of.astype(np.uint64) + np.uint64(1))))[1]) if len(hashes) else np.zeros(1, np.int64)
    line_hash = content_hashes(data.tobytes(), starts.tolist(), ends.tolist())
    dup = (words > 0) & _repeated(mix(line_hash ^ mix(text_of.astype(np.uint64) + np.uint64(7))))[1]
    counted = {k: _sums(f[data]) for k, f in (("letter", _LETTER), ("symbol", _SYMBOL), ("digit", _DIGIT), ("upper", _UPPER), ("solid", ~SPACE))}
    solid = np.maximum(counted["solid"][ends] - counted["solid"][starts], 1)
    share = {k: (c[ends] - c[starts]) / solid for k, c in counted.items()}
    measured = {
        "words": words, "symbol_share": share["symbol"], "letter_share": share["letter"], "digit_share": share["digit"], "upper_share": share["upper"],
        "word_bytes": solid / np.maximum(words, 1), "distinct_share": (new_word[l_last] - new_word[l_first]) / np.maximum(words, 1),
    }
    codes, bit = np.zeros(len(starts), np.int64), 0
    for name, limits in BINS.items():
        codes |= np.int64(1) << (bit + np.searchsorted(np.array(limits), measured[name], "left")).astype(np.int64)
        bit += len(limits) + 1
    some = words > 0
    last = np.zeros(len(starts), np.uint8)
    last[some] = data[w_ends[l_last[some] - 1] - 1]
    initial = np.zeros(len(starts), np.uint8)
    initial[some] = data[w_starts[l_first[some]]]
    for flag in (dup, some & _END[last], some & _UPPER[initial], some & _SYMBOL[last]):
        codes |= flag.astype(np.int64) << np.int64(bit)
        bit += 1
    # Counts of whole texts.
    w_text = np.repeat(np.arange(n), np.diff(w_first))
    repeat = np.zeros(len(hashes), bool)
    if len(hashes) > 2:
        three = gram_hashes(hashes, 3)
        inside = w_text[:-2] == w_text[2:]
        at = np.flatnonzero(inside)
        twice = at[_repeated(mix(three[at] ^ mix(w_text[at].astype(np.uint64) + np.uint64(3))))[0]]
        for k in range(3):
            repeat[twice + k] = True
    chars = _sums(((data & 0xC0) != 0x80) & ~SPACE[data])
    counts = {
        "n_words": np.diff(w_first), "word_chars": chars[offsets[1:]] - chars[offsets[:-1]], "n_symbols": counted["symbol"][offsets[1:]] - counted["symbol"][offsets[:-1]],
        "n_dup_lines": np.bincount(text_of[dup], minlength=n), "n_repeat_words": np.bincount(w_text[repeat], minlength=n),
    }
    return Lines(first, codes, words, counts)


def one_hot(codes: np.ndarray) -> np.ndarray:
    return ((codes[..., None] >> np.arange(N_FEATURES)) & 1).astype(np.float64)


@dataclass
class Field:
    """Weights of the conditional random field."""

    state: np.ndarray  # feature x label
    step: np.ndarray  # label x next label

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Viterbi: the best labels of one text's lines."""
        return self.decode_all(codes, np.array([0, len(codes)]))

    def decode_all(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The best labels of each text's lines; ties go to content."""
        scores = (one_hot(codes) @ self.state).tolist()
        (cc, cb), (bc, bb) = self.step.tolist()
        labels = np.zeros(len(codes), np.int8)
        bounds = first.tolist()
        for a, z in zip(bounds, bounds[1:], strict=False):
            c, b = scores[a]
            back = []
            for x, y in scores[a + 1 : z]:
                from_c, from_b = c + cc >= b + bc, c + cb >= b + bb
                c, b = (c + cc if from_c else b + bc) + x, (c + cb if from_c and from_b else c + cb if from_b else b + bb) + y
                back.append((from_c, from_b))
            now = CONTENT if c >= b else BOILERPLATE
            labels[z - 1] = now
            for k in range(len(back) - 1, -1, -1):
                now = CONTENT if back[k][now] else BOILERPLATE
                labels[a + k] = now
        return labels


def line_blocks(codes: list[np.ndarray], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """All lines of all texts in blocks of at most `size`, and the text of each block; a block begins with the last line of the one before, so that no transition is lost."""
    blocks = [(c[a : a + size], k) for k, c in enumerate(codes) for a in range(0, max(len(c) - 1, 1), size - 1)]
    return [b for b, _ in blocks], np.array([k for _, k in blocks])


def line_labels(margin: np.ndarray, words: np.ndarray, verdict: int, least_share: float) -> np.ndarray:
    """Labels of one text's lines: what their own margin (content over boilerplate) says, as far as the text's verdict allows.

    Lines with at least least_share of the words have the verdict's label: where the margins say less, the lines whose margin
    speaks least against the verdict take its label, the earlier of equal ones first. A text without words has it throughout.
    """
    towards = margin if verdict == CONTENT else -margin
    agree = towards >= 0
    need = least_share * words.sum() - words[agree].sum()
    if words.sum() == 0:
        agree[:] = True
    elif need > 0:
        against = np.flatnonzero(~agree & (words > 0))
        against = against[np.argsort(-towards[against], kind="stable")]
        agree[against[: np.searchsorted(np.cumsum(words[against]), need) + 1]] = True
    return np.where(agree, verdict, 1 - verdict)


def train_field(codes: list[np.ndarray], words: list[np.ndarray], verdicts: list[int], least_share: float = 0.6, rounds: int = 120, block_lines: int = 48) -> Field:
    """Fit the field to texts of which only the verdict is known, in two steps.

    First each line stands alone, without steps between labels, and has its text's verdict: the weights then say what a line's
    own features (repetition, structure, symbols) speak for. By them and the verdict each line gets its label (line_labels), so
    that labels vary within a text; the field with its steps is fitted to these sequences.
    """
    field = Field(np.zeros((N_FEATURES, 2)), np.zeros((2, 2)))
    if len(set(verdicts)) < 2:
        return field
    alike = [np.full(len(c), v) for c, v in zip(codes, verdicts, strict=True)]
    alone = _ascend(field, codes, alike, verdicts, rounds, block_lines, chained=False)
    weight = alone.state[:, CONTENT] - alone.state[:, BOILERPLATE]
    labels = [line_labels(one_hot(c) @ weight, w, v, least_share) for c, w, v in zip(codes, words, verdicts, strict=True)]
    return _ascend(alone, codes, labels, verdicts, rounds, block_lines, chained=True)


def _ascend(field: Field, codes: list[np.ndarray], labels: list[np.ndarray], verdicts: list[int], rounds: int, block_lines: int, chained: bool, rate: float = 0.2, decay: float = 1e-3) -> Field:
    """Maximise the conditional log likelihood of the label sequences; unless chained, steps between labels stay as they are.

    Longer texts are sequences of at most block_lines lines, all of which are used; this bounds the steps of a round, not what is learned from.
    """
    codes, text_of = line_blocks(codes, block_lines)
    length = np.array([len(c) for c in codes])
    x, y = np.zeros((2, len(codes), length.max()), np.int64)
    for row, label_row, c, one in zip(x, y, codes, line_blocks(labels, block_lines)[0], strict=True):
        row[: len(c)], label_row[: len(c)] = c, one
    live = np.arange(x.shape[1]) < length[:, None]
    each = np.array(verdicts)
    # Both kinds of text count alike, each text of a kind, and each line of a text.
    weight = np.where(each[text_of] == 1, 0.5 / (each == 1).sum(), 0.5 / (each == 0).sum()) / np.bincount(text_of, length)[text_of]
    hot = one_hot(x)
    moments = [np.zeros(N_FEATURES * 2 + 4) for _ in range(2)]
    for turn in range(1, rounds + 1):
        grad_state, grad_step = _gradient(field, hot, live, y, weight)
        flat = np.concatenate([(grad_state - decay * field.state).ravel(), (grad_step - decay * field.step).ravel() * chained])
        moments[0] = 0.9 * moments[0] + 0.1 * flat
        moments[1] = 0.99 * moments[1] + 0.01 * flat**2
        move = rate * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
        field = Field(field.state + move[:-4].reshape(-1, 2), field.step + move[-4:].reshape(2, 2))
    return field


def _gradient(field: Field, hot: np.ndarray, live: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scores = hot @ field.state
    n, size, _ = scores.shape
    ahead, behind = np.zeros((n, size, 2)), np.zeros((n, size, 2))
    ahead[:, 0] = scores[:, 0]
    for t in range(1, size):
        ahead[:, t] = np.where(live[:, t, None], scores[:, t] + np.logaddexp.reduce(ahead[:, t - 1, :, None] + field.step, axis=1), ahead[:, t - 1])
    for t in range(size - 2, -1, -1):
        onward = np.logaddexp.reduce(field.step + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], axis=2)
        behind[:, t] = np.where(live[:, t + 1, None], onward, 0.0)
    total = np.logaddexp.reduce(ahead[:, -1], axis=1)
    marginal = np.exp(ahead + behind - total[:, None, None]) * live[..., None]
    target = np.zeros_like(marginal)
    target[np.arange(n)[:, None], np.arange(size), y] = 1.0
    target *= live[..., None]
    by_line = (target - marginal) * weight[:, None, None]
    grad_state = np.einsum("ntf,ntl->fl", hot, by_line, optimize=True)
    pair = np.exp(ahead[:, :-1, :, None] + field.step + (scores + behind)[:, 1:, None, :] - total[:, None, None, None]) * live[:, 1:, None, None]
    grad_step = -(pair * weight[:, None, None, None]).sum(axis=(0, 1))
    for here in (0, 1):
        for onward in (0, 1):
            taken = (y[:, :-1] == here) & (y[:, 1:] == onward) & live[:, 1:]
            grad_step[here, onward] += (weight[:, None] * taken).sum()
    return grad_state, grad_step


def sample_labels(labels: DataFrame, most: int, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most `most` labelled ids by the order of a hash, those with crc32(id) mod 5 = 0 held out."""
    code = F.crc32(F.col(id_col).cast("string"))
    rows = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (code % 5 != 0))
    return rows.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def learn_field(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", most_docs: int = 1500) -> Field:
    """Train on all lines of at most most_docs labelled texts: most of a text of label 1 is content, most of the others is not."""
    schema = T.StructType([T.StructField("codes", T.BinaryType()), T.StructField("words", T.BinaryType()), T.StructField("label", T.IntegerType())])

    def coded(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = describe(*reversed(offsets_and_bytes(batch.column("text"))))
        kept = [pa.array([x[a:z].tobytes() for a, z in zip(lines.first, lines.first[1:], strict=False)], pa.binary()) for x in (lines.codes, lines.words)]
        return pa.RecordBatch.from_arrays([*kept, batch.column("label")], schema.names)

    chosen = F.broadcast(sample_labels(labels, most_docs, id_col, label_col))
    rows = map_texts(keyed(docs, id_col, text_col).join(chosen, F.col("id") == F.col("label_id")).select("text", "label"), coded, schema).collect()
    codes, words = ([np.frombuffer(r[c], np.int64) for r in rows] for c in ("codes", "words"))
    return train_field(codes, words, [CONTENT if r.label == 1 else BOILERPLATE for r in rows])


def judge_lines(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", least_content: float = 0.5) -> DataFrame:
    """Return id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_words and kept for every row.

    One pass without shuffle. kept: the base rules hold, and at least least_content of the words are in lines labelled content.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = T.StructType([id_field(docs, id_col, id_col), *(T.StructField(c, T.LongType()) for c in names), T.StructField("base_failed", T.BooleanType()),
                           T.StructField("content_words", T.LongType()), T.StructField("kept", T.BooleanType())])

    def judged(batch: pa.RecordBatch) -> pa.RecordBatch:
        lines = describe(*reversed(offsets_and_bytes(batch.column("text"))))
        content = np.concatenate([[0], np.cumsum(lines.words * (field.decode_all(lines.codes, lines.first) == CONTENT))])
        content = content[lines.first[1:]] - content[lines.first[:-1]]
        n = lines.counts["n_words"]
        failed = (n < 50) | (100 * lines.counts["n_repeat_words"] > 50 * n)
        kept = ~failed & (content >= least_content * n)
        columns = [*(lines.counts[c].astype(np.int64) for c in names), failed, content.astype(np.int64), kept]
        return pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, columns)], schema.names)

    return map_texts(keyed(docs, id_col, text_col), judged, schema)

"""All operators on nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, against brute force."""

import collections
import hashlib
import html
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from alidade.llm import html_text, queries
from alidade.llm.components import components
from alidade.llm.exact_dedup import exact_dedup
from alidade.llm.html_text import extract_text
from alidade.llm.language_id import identify_languages, learn_languages
from alidade.llm.mixing import mix_sources
from alidade.llm.ngram_join import jaccard_components
from alidade.llm.quality_classifier import RuleEnsemble, learn_quality, matches, score_quality, statistics
from alidade.llm.quality_rules import judge_lines, learn_field
from alidade.llm.substring_dedup import remove_earlier_passages
from alidade.llm.suffix_dedup import remove_repeated_strings

DATA = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHING = ["id", "row", "r", "n", "e", "k", "token", "span", "anchor", "cuts", "size", "score", "kept", "content", "word"]


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_rows():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(6)]
    passage = " ".join(rng.choices(vocabulary, k=70))
    rows = [(k, t, "a") for k, t in enumerate(base)]
    rows += [(10, base[0], "a"), (11, base[0].upper(), "b"), (11, base[0].upper(), "b"), (12, base[1] + " more", None), (13, base[1].replace("w1 ", "x1 "), "b")]
    rows += [(20, passage + "\n" + base[2], "c"), (21, base[3] + " " + passage, "c"), (22, passage, "c"), (22, "another text with id 22", "c")]
    rows += [(30, None, "a"), (31, "", "b"), (32, " \n\t", None), (33, "one", "é"), (34, "One two", "a"), (35, "one", "z"), (None, base[4], "a"), (None, "no id", None)]
    rows += [(40, "a " * 3000, "a"), (41, "x" * 9000, "b"), (42, "中文 текст 😀 " * 60, "c"), (43, "\x0b".join(vocabulary[:60]), "c"), (44, ("line one is here\n" * 30), "d")]
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, *[f"{c}!" for c in CLASHING]) for r in odd_rows()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING)).repartition(3).cache()


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_exact_dedup(odd, none):
    groups = collections.defaultdict(list)
    for k, t, _ in odd_rows():
        groups[lower(t or "")].append(k)
    want = []
    for t, ids in groups.items():
        top = max(ids, key=lambda i: (i is not None, i or 0))
        sha, left = hashlib.sha256(t.encode()).hexdigest(), 1
        for i in ids:
            want.append((i, top, len(ids), i == top and left == 1, sha))
            left -= i == top
    for budget in (64 << 20, 500):
        assert rows_of(exact_dedup(odd, budget=budget), "doc_id", "keep_id", "group_size", "kept", "content_sha256") == sorted(want, key=repr)
    assert exact_dedup(none).count() == 0


def brute_components(rows, n, percent):
    sets, parent = [], list(range(len(rows)))
    for _, t, _ in rows:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    least = {}
    for k, (i, _, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least.get(find(k)) if sets[k] else i) for k, (i, _, _) in enumerate(rows)]


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 30)])
def test_ngram_join(odd, n, percent):
    got = rows_of(jaccard_components(odd, n=n, percent=percent), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(odd_rows(), n, percent), key=repr)


def test_ngram_join_of_nothing(none):
    assert jaccard_components(none).count() == 0


def test_near_copies_that_link_in_a_chain(spark):
    rng = random.Random(2)
    words = [f"v{k}" for k in range(5000)]
    rows, text = [], rng.choices(words, k=100)
    for k in range(40):  # each differs a little from the one before, the ends have nothing in common
        rows.append((k, " ".join(text), None))
        text = text[3:] + rng.choices(words, k=3)
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert {r.component_id for r in jaccard_components(df).collect()} == {0}
    assert rows_of(jaccard_components(df, percent=99), "doc_id", "component_id") == [(k, k) for k in sorted(range(40), key=lambda k: repr((k, k)))]


def near_group(size, words, seed, edits):
    """Copies of one text with up to `edits` other words each."""
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(3000)]
    base, out = rng.choices(vocabulary, k=words), []
    for _ in range(size):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = rng.choice(vocabulary)
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_groups_of_near_copies(spark, n, percent):
    """Many pairs about the threshold, found by differences from a pivot."""
    texts = [t for g in ((60, 100, 0, 4), (40, 150, 1, 6), (30, 60, 2, 5), (120, 80, 5, 8)) for t in near_group(*g)]
    rows = [(k, t, None) for k, t in enumerate(texts)]
    out = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), n=n, percent=percent)
    want = sorted(brute_components(rows, n, percent), key=repr)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == want and 4 < len({c for _, _, c in want}) < len(rows)


def thue_morse(letters, length):
    return "".join(letters[bin(k).count("1") % 2] for k in range(length))


def test_contrived_words_and_lines_are_told_apart(spark):
    """Such words collide under polynomials modulo powers of two."""
    rows = [(1, thue_morse("ab", 1024)), (2, thue_morse("ba", 1024)), (3, thue_morse("ab", 1024) + "\n" + thue_morse("ba", 1024))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.component_id for r in jaccard_components(df, n=1, percent=90).orderBy("doc_id").collect()] == [1, 2, 3]
    assert [r.n_dup_lines for r in judge_lines(df, learn_field(df, spark.createDataFrame([], "doc_id long, quality int"))).orderBy("doc_id").collect()] == [0, 0, 0]
    rows = [(1, " ".join([thue_morse("ab", 1024)] * 60)), (2, " ".join([thue_morse("ba", 1024)] * 60))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in remove_earlier_passages(df).collect()] == [0, 0]


@pytest.mark.parametrize("anchor_bytes", [1, 16 << 20])
def test_hot_anchors_are_parted(odd, anchor_bytes):
    from alidade.llm.repeats import Unit, remove_repeats
    from alidade.llm.suffix_dedup import repeated_windows

    def solve(contents, times, _):
        covers = repeated_windows(contents, times, 60)
        return covers, covers

    got = remove_repeats(odd, "doc_id", "text", Unit(False, 60, 16), solve, False, anchor_bytes=anchor_bytes)
    want = remove_repeated_strings(odd, window=60, gram=16)
    assert rows_of(got, *got.columns) == rows_of(want, *want.columns)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    assert rows_of(components(spark.createDataFrame(edges, "a long, b long")), "node", "root") == sorted(((k, find(k)) for k in parent), key=repr)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_suffix_dedup(odd, none):
    rows, window = odd_rows(), 60
    texts = [(t or "").encode() for _, t, _ in rows]
    count = collections.Counter(t[k : k + window] for t in texts for k in range(len(t) - window + 1))
    want = []
    for (i, _, _), t in zip(rows, texts, strict=True):
        flags = np.zeros(len(t) + 1, bool)
        for k in range(len(t) - window + 1):
            if count[t[k : k + window]] > 1:
                flags[k : k + window] = True
        flags = flags[:-1]
        runs = int((np.diff(np.concatenate([[0], flags.astype(int)])) == 1).sum())
        want.append((i, len(t), int(flags.sum()), runs, bytes(np.frombuffer(t, np.uint8)[~flags])))
    got = remove_repeated_strings(odd, window=window, gram=16)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept") == sorted(((i, a, b, c, bytearray(k)) for i, a, b, c, k in want), key=repr)
    assert remove_repeated_strings(none).count() == 0


def test_substring_dedup(odd, none):
    rows, window = odd_rows(), 20
    words = [(t or "").encode().split() for _, t, _ in rows]
    least = {}
    for (i, _, _), w in zip(rows, words, strict=True):
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                least[key] = min(least.get(key, i), i)
    want = []
    for (i, _, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        want.append((i, len(w), len(gone), bytearray(b" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = remove_earlier_passages(odd, window=window, gram=5)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept") == sorted(want, key=repr)
    assert remove_earlier_passages(none).count() == 0


def test_registered_dedup_queries_by_brute_force(spark):
    """op2 and op8 as registered, at their own windows of 200 bytes and 50 words."""
    docs = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    count = collections.Counter(t[k : k + 200] for _, t in docs for k in range(len(t) - 199))
    least, want = {}, {"op2_suffix_dedup": [], "op8_substring_dedup": []}
    for i, t in docs:
        w = t.split()
        for k in range(len(w) - 49):
            key = hash(tuple(w[k : k + 50]))
            least[key] = min(least.get(key, i), i)
    for i, t in docs:
        flags, w = np.zeros(len(t) + 2, np.int8), t.split()
        for k in range(len(t) - 199):
            if count[t[k : k + 200]] > 1:
                flags[k + 1 : k + 201] = 1
        runs, gone = int((np.diff(flags) == 1).sum()), flags[1:-1].astype(bool)
        want["op2_suffix_dedup"].append((i, len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
        lost = {k + j for k in range(len(w) - 49) if least[hash(tuple(w[k : k + 50]))] < i for j in range(50)}
        want["op8_substring_dedup"].append((i, len(w), len(lost), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in lost)).hexdigest()))
    for name, rows in want.items():
        df = queries.QUERIES[name](spark, DATA)
        assert rows_of(df, *df.columns) == sorted(rows, key=repr), name
        assert sum(r[2] for r in rows) > 0


def test_segments(spark, monkeypatch):
    """A text longer than a segment of windows is read in parts."""
    from alidade.llm import repeats
    from alidade.llm.words import byte_codes

    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    first = np.array([0, 3000, 3000, 3050, 5000])
    unit, levels = repeats.Unit(False, 100, 20), np.zeros(1 << 22, np.uint8)
    whole = repeats.find_spans(byte_codes()[data], first, unit, levels)
    monkeypatch.setattr(repeats, "SEGMENT", 256)
    parts = repeats.find_spans(byte_codes()[data], first, unit, levels)
    covered = [sorted(k for b, c in zip(begin, count, strict=True) for k in range(b, b + c)) for _, begin, count in (whole, parts)]
    assert covered[0] == covered[1] == [*range(2901), *range(3050, 4901)]
    assert set(parts[0].tolist()) == set(whole[0].tolist())


def test_mixing(odd, none):
    out = mix_sources(odd).collect()
    assert len(out) == len(odd_rows())
    sizes = collections.Counter()
    for _, t, s in odd_rows():
        sizes[s] += len(WORD.findall(t or ""))
    assert all(r.source_size == sizes[r.source] and 0 <= r.taken <= 2 * r.size for r in out)
    target = {r.source: r.target for r in out}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted((s for s in sizes if s is not None), key=lambda s: s)) }
    weight[None] = (3, 1, 2)[len(weight) % 3]
    left, want, full = 1.5 * sum(sizes.values()), {}, set()
    while True:  # what is above goes back and is shared anew
        open_ = [s for s in sizes if s not in full]
        level = (left - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: 2 * sizes[s] if s in full else level * weight[s] for s in sizes}
    assert all(math.isclose(target[s], want[s], rel_tol=1e-12) for s in sizes)
    for s in sizes:
        rows = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in rows) - target[s]) <= max(r.size for r in rows) / 2 + 1
        assert all(r.taken >= r.size * int(target[s] // sizes[s]) for r in rows)
    assert sorted(map(repr, out)) == sorted(map(repr, mix_sources(odd.repartition(5)).collect()))
    assert mix_sources(none).count() == 0
    silent = mix_sources(odd.where("doc_id in (30, 31, 32)")).collect()
    assert [(r.taken, r.target) for r in silent] == [(0, 0.0)] * 3


def test_better_documents_come_first(spark):
    rows = [(k, ("# $ " if k % 2 else "word and ") * 20, "s", 0) for k in range(4000)] + [(9999, "w " * 2000, "t", 0)]
    out = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string, n int"), share=0.4)
    taken = [r.doc_id for r in out.where("source = 's' and taken > 0").collect()]
    assert 0.05 < sum(k % 2 for k in taken) / len(taken) < 0.35


def test_quality_rules(odd, none):
    field = learn_field(*(odd.sparkSession.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels")))
    want = []
    for i, t, _ in odd_rows():
        t = t or ""
        w = WORD.findall(t)
        windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        repeat = {k + j for k in range(len(w) - 2) for j in range(3) if windows[tuple(w[k : k + 3])] > 1}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        failed = len(w) < 50 or 100 * len(repeat) > 50 * len(w)
        want.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat), failed))
    out = judge_lines(odd, field)
    assert rows_of(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want, key=repr)
    assert all(not r.kept or not r.base_failed for r in out.collect()) and judge_lines(none, field).count() == 0
    assert learn_field(none, odd.sparkSession.createDataFrame([], "doc_id long, quality int")).state.sum() == 0


def test_quality_rules_label_lines_within_a_text(spark):
    """Texts of both kinds mix plain lines and junk; every line is told apart and the share of content decides, in labelled texts and others."""
    plain = ["Some plain words of a line that go on and on to its end.", "It was here that others had come by before them and stayed.", "Nobody knew why they came or where they meant to go after."]
    junk = ["buy $$$ | now ### | 9 9 9", "# $ | more %%% | 1 2 3", "<a> & <b> | *** | 7 7"]
    rows = []
    for k in range(60):
        share = 8 if k % 2 == 0 else 2
        mixed = [(plain if (j * 7 + k) % 10 < share else junk)[(j + k) % 3] + f" {'abcdefghij'[j % 10] * (j // 10 + 1)}" for j in range(20)]
        rows.append((k, "\n".join(mixed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = learn_field(docs, spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int"))
    for r in judge_lines(docs, field).collect():
        lines = rows[r.doc_id][1].split("\n")
        want = sum(len(x.split()) for x in lines if x[:8] in {p[:8] for p in plain})
        assert r.content_words == want and 0 < want < r.n_words
        assert r.kept == (not r.base_failed and 2 * want >= r.n_words)


def test_quality_rules_learn_from_late_lines(spark):
    """Texts of both kinds begin alike; only lines after the first hundred differ."""
    head = "\n".join(f"plain words of line {k} that go on." for k in range(100))
    rows = [(k, head + ("\n# $ | # $ |" if k % 2 else "\nplain words to the end.") * 60) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = learn_field(docs, spark.createDataFrame([(k, 1 - k % 2) for k in range(40)], "doc_id long, quality int"))
    out = {r.doc_id: r.content_words / r.n_words for r in judge_lines(docs, field).collect()}
    assert all(out[k] > 0.9 if k % 2 == 0 else out[k] < 0.9 for k in range(40))


def test_quality_classifier(odd, none):
    docs, labels = (odd.sparkSession.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = score_quality(odd, learn_quality(docs, labels))
    assert out.columns == [*(c for c in odd.columns if c != "score"), "score", "predicted"]
    assert out.count() == len(odd_rows()) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.collect())
    assert score_quality(none, RuleEnsemble()).count() == 0
    assert {r.score for r in score_quality(odd, learn_quality(none, labels)).collect()} == {0.5}


def brute_statistics(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    n, some = max(len(text), 1), max(len(words), 1)
    share = [sum(c in kinds for c in text) / n for kinds in ("#*$%&|<>", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?")]
    return [math.log1p(len(words)), *share, sum(map(len, words)) / some, len(set(words)) / some, len(set(lines)) / len(lines), len(words) / len(lines)]


def test_quality_scores_by_brute_force(odd):
    """Statistics counted in Python, rules held against them in numpy, and the fit, which does not depend on the order of rows."""
    docs, labels = (odd.sparkSession.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = learn_quality(docs, labels)
    turned = learn_quality(docs.repartition(5, "text"), labels.repartition(3, "quality"))
    assert turned.rules == model.rules and turned.bias == model.bias and model.rules
    for some in (docs.select("doc_id", "text"), odd.select("doc_id", "text")):
        rows = some.select("text", *(c.alias(k) for k, c in statistics(some["text"]).items())).collect()
        x = np.array([brute_statistics(r.text) for r in rows])
        assert np.allclose(x, np.array([tuple(r)[1:] for r in rows]), atol=1e-12)
        total = model.bias + sum(w * matches(b, x, list(statistics(some["text"]))) for b, w in model.rules)
        want = collections.Counter(zip((r.text for r in rows), np.round(1 / (1 + np.exp(-total)), 9).tolist(), strict=True))
        assert collections.Counter((r.text, round(r.score, 9)) for r in score_quality(some, model).collect()) == want


def test_rows_without_an_id_are_in_no_fold(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    docs.unionByName(docs.limit(1).withColumn("doc_id", docs.doc_id * None)).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_quality_classifier", "op5_language_id"):
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        divisor, rest = (5, 0) if name.startswith("op1") else (4, 2)
        assert len(got) == docs.count() + 1 and all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % divisor == rest) for r in got)


def test_language_id(odd, none):
    docs = odd.sparkSession.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = learn_languages(docs)
    right = [r.lang == r.lang_pred for r in identify_languages(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert sum(right) / len(right) > 0.97
    out = {r.doc_id: r for r in identify_languages(odd, net).collect()}
    assert all(out[k].lang_pred == "und" and out[k].score == 0 for k in (30, 31, 32)) and out[33].lang_pred in net.langs
    numbers = odd.sparkSession.createDataFrame([(1, "12 34 !?"), (2, "² ½ Ⅷ"), (3, "é")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in identify_languages(numbers, net).orderBy("doc_id").collect()] == [True, True, False]
    assert identify_languages(none, net).count() == 0
    assert learn_languages(docs.limit(0)) is None and {r.lang_pred for r in identify_languages(odd, None).collect()} == {"und"}


def test_language_id_learns_rare_languages_and_late_windows(spark):
    """One row in 250 is of a third language, and two of the languages differ after the first 384 bytes only."""
    head = "0 1 2 3 4 5 6 7 " * 24
    tail = {"aa": "alpha beta gamma ", "bb": "domo kuri neste ", "cc": "xyz wvu xyzzy "}
    rows = [(k, lang := "cc" if k % 250 == 1 else ("aa", "bb")[k % 2], head + tail[lang] * 60) for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    net = learn_languages(docs, most_docs=60)
    assert net.langs == ["aa", "bb", "cc"]
    got = identify_languages(docs, net).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) > 0.95 * len(got)


def test_bpe(odd, none):
    from alidade.llm.bpe import bpe_round_trip, encoding

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    enc, _ = encoding(path, public_tokenizers.PATTERN)
    for chunk in (100_000, 50):
        out = bpe_round_trip(odd, path, public_tokenizers.PATTERN, chunk_chars=chunk)
        want = [(i, bytearray(np.array(enc.encode_ordinary(t or ""), "<u4").tobytes()), bytearray((t or "").encode())) for i, t, _ in odd_rows()]
        assert rows_of(out, "doc_id", "ids", "decoded") == sorted(want, key=repr)
    assert bpe_round_trip(none, path, public_tokenizers.PATTERN).count() == 0


def test_html(spark):
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    want = []
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.DOTALL)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", article.replace("<br>", " "))]
        want.append((r.page_id, r.url, "\n\n".join(b for b in blocks if b)))
    assert rows_of(extract_text(pages), "page_id", "url", "text") == sorted(want, key=repr)
    notice = "<p>We use biscuits on all of our pages and you should like them</p>"
    made = [(k, "http://h.example/%d" % k, f"<body>{notice}<p>text of its own number {k} that stands nowhere else at all</p></body>", "x") for k in range(4)]
    made += [(9, None, None, "x"), (9, None, None, "x"), (10, "", "", "x"), (11, "http://h.example/", notice, "x")]
    out = extract_text(spark.createDataFrame(made, "page_id long, url string, html string, host string"), shard_pages=100)
    got = {r.page_id: r.text for r in out.collect()}
    assert out.count() == 8 and got[2] == "text of its own number 2 that stands nowhere else at all" and got[9] == got[10] == got[11] == ""
    assert extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shard_pages", [1, 7, 256])
def test_repetition_over_a_whole_host(spark, shard_pages):
    """Two of 600 pages share a notice; it goes, however many pages a suffix array is built for."""
    notice = "<p>only two pages of this large host have this notice of ours</p>"
    own = {k: " ".join(f"u{k}x{j}" for j in range(12)) for k in range(600)}
    made = [(k, f"http://big.example/{k}", f"<body>{notice if k in (3, 590) else ''}<p>{own[k]}</p></body>") for k in range(600)]
    made.append((1000, "http://other.example/", f"<body>{notice}</body>"))
    out = extract_text(spark.createDataFrame(made, "page_id long, url string, html string").repartition(4), shard_pages=shard_pages)
    got = {r.page_id: r.text for r in out.collect()}
    assert got == own | {1000: notice[3:-4]}


def test_repeated_runs_are_cut_out_of_blocks(spark):
    notice = "we use biscuits on all of our pages and like them"
    u = [" ".join(f"u{k}x{j}" for j in range(n)) for k, n in enumerate([6, 6, 30, 12, 12, 40])]
    made = [
        (0, "http://h.example/0", f"<div>{u[0]}<br>{notice}<br>{u[1]}</div>"),  # more than half is repeated
        (1, "http://h.example/1", f"<div>{u[2]} {notice}</div><p>{notice}</p>"),  # less than half, and all of a block
        (2, "http://h.example/2", f"<nav>here</nav><p>{u[3]}</p><p>{notice} {u[4]}</p>"),
        (3, "http://h.example/2?print", f"<nav>there</nav><p>{u[3]}</p><p>{notice} {u[4]}</p>"),  # mirrors
        (4, "http://m.example/a", f"<p>{u[5]}</p>"), (5, "http://m.example/b", f"<p>{u[5]}</p>"),
        (6, "http://n.example/", f"<p>{u[3]} x</p>"), (6, "http://n.example/", f"<p>{u[3]} y</p>"),  # one page, read twice
        (10, "http://l.example/1", f"<ul><li>go home<li>see the shop<li>ask our staff</ul><p>as ever {u[0]}</p>"),
        (11, "http://l.example/2", f"<ul><li>go home<li>see the shop<li>ask our staff</ul><p>as ever {u[1]}</p>"),
        (7, None, f"<p>{notice} one</p>"), (8, "/relative", f"<p>{notice} two</p>"), (9, "", f"<p>{notice} three</p>"),
    ]
    out = extract_text(spark.createDataFrame(made, "page_id long, url string, html string").repartition(3), shard_pages=2)
    want = [(0, f"{u[0]} {u[1]}"), (1, u[2]), (2, f"{u[3]}\n\n{u[4]}"), (3, f"{u[3]}\n\n{u[4]}"), (4, u[5]), (5, u[5]), (6, f"{u[3]} x"), (6, f"{u[3]} y")]
    want += [(7, f"{notice} one"), (8, f"{notice} two"), (9, f"{notice} three")]
    want += [(10, f"as ever {u[0]}"), (11, f"as ever {u[1]}")]
    assert rows_of(out, "page_id", "text") == sorted(want, key=repr)


@pytest.mark.parametrize("parts", [1, 5])
def test_notices_are_cut_out_of_articles(spark, parts):
    """A run on more than half of a host's distinct articles goes; one on half of them, on few, or on near copies stays."""
    notice = "we use biscuits on all of our pages and like them"
    u = [" ".join(f"u{k}x{j}" for j in range(30)) for k in range(12)]

    def page(host, k, body):
        return 100 * ord(host) + k, f"http://{host}.example/{k}", f"<nav>menu</nav><article>{body}</article>"

    made = [page("a", k, f"<h1>t{k}</h1><p>{u[k]} {notice}</p>" if k % 2 else f"<p>{notice}</p><p>{u[k]}</p>") for k in range(9)]
    made += [page("a", k, f"<p>{u[k]}</p>") for k in range(9, 12)] + [page("a", 12, f"<p>short</p><p>{notice}</p>")]
    made += [page("b", k, f"<p>{u[k % 3]}</p><p>{notice}</p>") for k in range(12)]  # three articles under several addresses
    made += [page("c", k, f"<p>{u[k]}</p><p>{notice if k < 6 else ''}</p>") for k in range(12)]  # half
    made += [page("d", k, f"<p>{u[k]}</p><p>{notice}</p>") for k in range(7)]  # few
    made += [page("e", k, f"<p>{u[0]} day {k} {u[1]}</p>") for k in range(12)]  # near copies
    made += [(r[0], r[1] + "?print", r[2]) for r in made[:2]] + [(7, None, made[0][2])]
    got = rows_of(extract_text(spark.createDataFrame(made, "page_id long, url string, html string").repartition(parts), shard_pages=3), "page_id", "text")
    want = [(i, re.sub("(\n\n)+", "\n\n", re.sub("<[^>]*>", "\n\n", h[len("<nav>menu</nav>") :])).strip()) for i, _, h in made]
    want = [(i, t.replace(notice, "").strip() if 9700 <= i < 9800 else t) for i, t in want]
    assert got == sorted(want, key=repr)


def test_notices_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    made = []
    for k in range(160):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            words[(at := rng.randint(0, len(words))) : at] = rng.choice(["a b c d", "b c d e f", "g h i"]).split()
        made.append((k, f"http://h{k % 7 % 4}.example/", f"<article>{' '.join(words)}</article>", words))
    made += [(k, url, h, w) for k, (_, url, h, w) in enumerate(made[:30], 200)]
    want = []
    for k, url, _, words in made:
        texts = {tuple(w) for _, u, _, w in made if u == url and w}
        runs = collections.Counter(r for t in texts for r in {t[j : j + 3] for j in range(len(t) - 2)})

        def gone(t, some):
            return {j + i for j in range(len(t) - 2) if tuple(t[j : j + 3]) in some for i in range(3)}

        shared = {r for r, n in runs.items() if n >= 4 and 2 * n > len(texts)}
        voting = [t for t in texts if 2 * len(gone(t, shared)) <= len(t)]
        runs = collections.Counter(r for t in voting for r in {t[j : j + 3] for j in range(len(t) - 2)} & shared)
        cut = gone(words, {r for r, n in runs.items() if n >= 4 and 2 * n > len(texts)})
        want.append((k, " ".join(w for j, w in enumerate(words) if j not in cut)))
    assert any(len(t.split()) < len(w) for (_, t), (_, _, _, w) in zip(want, made, strict=True))
    pages = spark.createDataFrame([m[:3] for m in made], "page_id long, url string, html string").repartition(3)
    for listed in (512, 1):
        monkeypatch.setattr(html_text, "LISTED_SLOTS", listed)
        monkeypatch.setattr(html_text, "HELD_SLOTS", listed * 100)
        assert rows_of(extract_text(pages, run=3, shard_pages=20, few=4), "page_id", "text") == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df = queries.QUERIES[name](spark, DATA)
    result = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    assert rows_of(df, *columns) == sorted(result.fetchall(), key=repr) and sorted(columns) == sorted(df.columns)


def test_queries_have_the_columns_asked_for(spark):
    want = {
        "op1": "doc_id held_out score predicted", "op2": "doc_id n_bytes n_removed n_spans kept_sha256", "op3": "doc_id size source_size target taken", "op4": "doc_id n_shingles component_id",
        "op5": "doc_id held_out lang_pred score", "op6": "doc_id keep_id group_size kept text_sha256", "op7": "page_id url text n_chars", "op8": "doc_id n_words n_removed kept_sha256",
        "op9": "doc_id n_tokens ids_sha256 decoded_sha256", "op10": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    }
    for name, query in queries.QUERIES.items():
        assert query(spark, DATA).columns == want[name.split("_")[0]].split()


def test_pipeline(spark, tmp_path):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    steps = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing sources to target weights", "byte-level BPE"]
    good = steps["quality classifier"](spark, docs, DATA)
    quality = {r.doc_id: r.quality for r in labels.collect()}
    stays = {r.doc_id for r in good.collect()}
    assert good.columns == docs.columns and all((k in stays) == (q == 1) for k, q in quality.items())
    extra = [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "a b c d e f", "en", None, 1), (907, "Twice here", "en", "s", 2), (907, "Twice here", "en", "s", 2), (908, "twice here", "de", "s", 2)]
    some = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    rows = some.collect()
    exact = steps["exact dedup"](spark, some, DATA)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[lower(r.text or "")].append(-1 if r.doc_id is None else r.doc_id)
    assert exact.columns == docs.columns and sorted(-1 if r.doc_id is None else r.doc_id for r in exact.collect()) == sorted(max(g) for g in groups.values())
    again = docs.unionByName(docs.where("doc_id < 3"))
    assert steps["exact dedup"](spark, again, DATA).count() == steps["exact dedup"](spark, docs, DATA).count()
    kept = exact.collect()
    near = steps["n-gram Jaccard join"](spark, exact, DATA)
    found = brute_components([(-1 if r.doc_id is None else r.doc_id, r.text, None) for r in kept], 5, 80)
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in near.collect()) == sorted({c for _, _, c in found})
    mixed = steps["mixing sources to target weights"](spark, near, DATA)
    times = collections.Counter(r.doc_id for r in mixed.collect())
    taken = {r.doc_id: r.taken // r.size for r in mix_sources(near.withColumn("doc_id", near.doc_id)).collect() if r.size}
    assert mixed.columns == docs.columns and max(times.values()) <= 2 and abs(sum(times.values()) - sum(taken.values())) <= 0.2 * sum(taken.values())
    coded = steps["byte-level BPE"](spark, mixed, DATA).collect()
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert sum(times.values()) == len(coded) and all(r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest() and len(r.ids) == 4 * r.n_tokens for r in coded)
    clashing = docs.withColumns({c: docs.doc_id for c in ("_a", "_b", "_row", "_nth", "_times", "_copy", "row", "score", "predicted", "kept")}).limit(40)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), DATA).count() == 0, name
        if name != "byte-level BPE":
            out = stage(spark, clashing, DATA)
            assert out.columns == clashing.columns and all(r["_a"] == r["_copy"] == r["row"] == r["score"] == r.doc_id for r in out.collect()), name


def test_mix_stage_row_by_row(spark):
    """Each row as often as the mix over the same row ids takes it, equal rows together."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    docs = docs.unionByName(docs.where("doc_id < 3"))
    marked = corpus_pipeline._marked(docs)
    row = {repr(r["_row"]): tuple(r["row"]) for r in marked.collect()}
    want = collections.Counter()
    for r in mix_sources(marked, id_col="_row").collect():
        want[row[repr(r["_row"])]] += r.taken // r.size if r.size else 0
    got = collections.Counter(tuple(r) for r in corpus_pipeline.mix_stage(spark, docs, DATA).collect())
    assert got == +want and len(got) > 50


def test_the_rest_works_without_this_subpackage():
    import subprocess
    import sys

    code = "import sys; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pipeline' not in e.queries() and 'daily_panel' in e.queries() and not any('op1' in q for q in e.oracle_sql())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(corpus_pipeline.__file__))

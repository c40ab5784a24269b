"""N-gram Jaccard join with adaptive multi-match prefixes.

A text's set holds the hashes of its distinct word n-grams. All sets are ordered by the same rule: rarer n-grams
first, as a sketch of counts over all texts tells. Two sets of n and m members that link share at least t(n) and
t(m) members, so their first n - t(n) + l and m - t(m) + l members have l in common, for any l up to t. Each
set takes the l that makes its estimated cost least: a longer prefix costs more postings, but asks for
more shared members before a pair is verified. A pair needs the smaller of its two l.

Equal sets are one class from the start. A class is compared with the leaders of its prefix members' lists first; those that share
half of what is asked for make a bundle, whose first class is its pivot. Within a bundle pairs are found by differences from the pivot. If D is what
a class and the pivot do not share, the classes x and y differ in |Dx| + |Dy| - 2 |Dx and Dy| members, so that they link if and only if

    (100 + p) (|Dx| + |Dy|) - (100 - p) (n + m) <= 2 (100 + p) |Dx and Dy|        p: the percentage asked for

which parts into a number of each class, its need, and what their differences share. Classes whose needs add up to nothing link
without a look, and all such pairs hang together by the class of the least need; all others must share differences, and have enough of them among
the rarest of the bundle: their prefix again. So a large group of near copies makes neither all its pairs nor those that only seem alike
because they are copies of one text. Classes of different bundles that share enough prefix members are compared as they are.

Pairs that are in one component already are not made again. No list, bundle or class is cut short, so the links are exact.

Defined results: A-Z are lower-cased; words are parted by the bytes 9 to 13 and 32; a text of fewer
words than an n-gram has its whole sequence as its one member; a null, empty or blank text has an empty set and
is linked with nothing, its component being its own id; null ids are not the smallest of a component that has others; rows with the same id and text are one class;
members are told apart by 64-bit hashes and sets by 128-bit ones; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from alidade.llm.common import id_field, if_small, keyed, map_texts, offsets_and_bytes, release, saved
from alidade.llm.components import components
from alidade.llm.sketch import level_of, noise_level, sketch_levels
from alidade.llm.words import LOWER, gram_hashes, mix, word_hashes, word_spans

#: Bytes of text for each n-gram, for the size of the sketch.
GRAM_BYTES = 7
#: Other classes that a member is taken to meet by chance, if the sketch knows of none.
CHANCE = 0.25


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    grams = gram_hashes(words, n)
    out = []
    for a, z in zip(first.tolist(), first.tolist()[1:], strict=False):
        if z - a >= n:
            out.append(np.unique(grams[a : z - n + 1]))
        else:
            whole = np.full(1, z - a, np.uint64)
            for w in words[a:z]:
                whole = mix(whole * np.uint64(3) + w)
            out.append(whole[: z - a])
    return out


def set_name(members: np.ndarray) -> bytes:
    """128 bits that tell sets apart."""
    two = (mix(members).sum(dtype=np.uint64), mix(members ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64))
    return np.array(two, np.uint64).tobytes()


def need(n: np.ndarray | int, percent: int) -> np.ndarray | int:
    """Members that a set of n shares at least with any set it links to."""
    return (percent * n + 99) // 100


def matches_up_to(t: int) -> list[int]:
    """The numbers of shared members that a set may ask for: up to t, a half or a third apart."""
    out, step = [1], 2
    while step < t:
        out += [m for m in (step, step * 3 // 2) if out[-1] < m < t]
        step *= 2
    return out + [t] if t > 1 else out


def prefix(members: np.ndarray, levels: np.ndarray, noise: float, percent: int) -> tuple[np.ndarray, int]:
    """The members that are posted, in order, and how many of them a partner must share."""
    if not len(members):
        return members, 0
    size = len(members)
    t = need(size, percent)
    level = level_of(members, levels)
    order = np.lexsort((members, level))
    others = np.maximum(2.0 ** (level[order] / 2.0) - noise, CHANCE)
    hits = np.cumsum(others)
    choices = np.array(matches_up_to(t))
    longest = size - t + choices
    best = int(np.argmin(longest + hits[longest - 1] * (1 + 0.1 * size / choices)))
    return members[order[: longest[best]]], int(choices[best])


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90) -> DataFrame:
    """Return id_col, n_shingles and component_id for every row; two texts link when 100 * shared >= percent * union."""
    texts = keyed(docs, id_col, text_col)
    levels = sketch_levels(texts, lambda data, offsets: np.concatenate(shingle_sets(data, offsets, n)), GRAM_BYTES)
    noise = noise_level(levels)
    cell = texts.sparkSession.sparkContext.broadcast(levels)
    schema = T.StructType([id_field(docs, id_col), T.StructField("e", T.BinaryType()), T.StructField("n", T.IntegerType()),
                           T.StructField("need", T.IntegerType()), T.StructField("tokens", T.ArrayType(T.LongType()))])

    def described(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(*reversed(offsets_and_bytes(batch.column("text"))), n)
        rows = [prefix(s, cell.value, noise, percent) for s in sets]
        columns = [pa.array([set_name(s) for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int32()), pa.array([m for _, m in rows], pa.int32()), _lists([p for p, _ in rows])]
        return pa.RecordBatch.from_arrays([batch.column("id"), *columns], schema.names)

    rows = saved(map_texts(texts, described, schema), "ngram-rows")
    classes = rows.where("n > 0").groupBy("e").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("need").alias("need"), F.first("tokens").alias("tokens"))
    # Written once, so the number of a class stays what it is.
    sets = saved(classes.withColumn("k", F.monotonically_increasing_id()), "ngram-sets")
    posted = sets.select("k", "n", "need", F.posexplode("tokens").alias("pos", "token"))
    lists = posted.groupBy("token").agg(F.min("k").alias("low"), F.max("k").alias("high")).where("low < high").select("token")
    posted = saved(posted.join(lists, "token"), "ngram-lists")

    # The leader of a list is its least class of about the same size, by either of two scales of sizes, so that no group is parted by both.
    led, step = [], math.log(max(100 / percent, 1.01))
    for shift in (0.0, 0.5):
        sized = posted.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(step) + F.lit(shift)))
        lead = sized.groupBy("token", "band").agg(F.min(F.struct("k", "n", "need", "pos")).alias("lead"))
        both = sized.join(lead, ["token", "band"]).select(*(F.col(c).alias(c + "a") for c in ("k", "n", "need", "pos")), *(F.col("lead")[c].alias(c + "b") for c in ("k", "n", "need", "pos")))
        near = both.where((F.col("ka") > F.col("kb")) & (F.least("na", "nb") * 200 >= F.greatest("na", "nb") * percent)).groupBy("ka", "kb")
        near = near.agg(F.count("*").alias("shared"), F.first(F.least("needa", "needb")).alias("asked")).where("shared * 2 >= asked")
        led.append(near.groupBy("ka").agg(F.max_by("kb", F.struct("shared", "kb")).alias("kb")))
    pairs = saved(led[0].union(led[1]).distinct(), "ngram-pairs")
    members = _members(pairs, sets, texts, docs, n)
    a, b = members.toDF("ka", "na", "ma"), members.toDF("kb", "nb", "mb")
    compared = pairs.join(a, "ka").join(b, "kb").select("ka", "kb", "na", "nb", F.size(F.array_intersect("ma", "mb")).alias("shared"))
    compared = saved(compared.where(_alike(max(percent // 2, 1))), "ngram-compared")
    bundles = components(compared.select(F.col("ka").alias("a"), F.col("kb").alias("b")), "ngram-bundles")
    linked = compared.where(_alike(percent)).select(F.col("ka").alias("a"), F.col("kb").alias("b"))
    links = _within_bundles(bundles, members, linked, percent)
    release(pairs, members, compared)

    known = bundles.select(F.col("node").alias("k"), "root")
    posted_b = posted.join(known, "k", "left").select("k", "n", "need", "pos", "token", F.coalesce("root", "k").alias("bundle"))
    mixed = posted_b.groupBy("token").agg(F.min("bundle").alias("lowest"), F.max("bundle").alias("highest")).where("lowest < highest").select("token")
    across = saved(posted_b.join(mixed, "token", "left_semi"), "ngram-across")
    release(posted)
    a, b = (across.select("token", *(F.col(c).alias(c + s) for c in ("k", "n", "need", "pos", "bundle"))) for s in "ab")
    wanted = a.join(b, (a["token"] == b["token"]) & (F.col("ka") < F.col("kb")) & (F.col("bundlea") != F.col("bundleb")) & _may_link(percent))
    pairs = saved(_candidates(wanted, percent).select("ka", "kb"), "ngram-pairs")
    members = _members(pairs, sets, texts, docs, n)
    a, b = members.toDF("ka", "na", "ma"), members.toDF("kb", "nb", "mb")
    compared = pairs.join(a, "ka").join(b, "kb").withColumn("shared", F.size(F.array_intersect("ma", "mb"))).where(_alike(percent))
    more = saved(compared.select(F.col("ka").alias("a"), F.col("kb").alias("b")), "ngram-links")
    release(across, pairs, members, bundles)

    roots = components(links.union(more), "ngram-components")
    release(links, more)
    named = sets.select("k", "e", "id").join(roots, F.col("k") == F.col("node"), "left").select("e", "id", F.coalesce("root", "k").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("least"))
    named = named.join(least, "root").select("e", "least")
    found = rows.select("id", "e", "n").join(named, "e", "left")
    return found.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("id")).alias("component_id"))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    limits = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate([np.zeros(0, np.uint64), *arrays]).astype(np.uint64)
    return pa.ListArray.from_arrays(pa.array(limits), pa.array(values.view(np.int64)))


def _may_link(percent: int) -> Column:
    """Whether two sets that share a member at posa and posb of their orders have the sizes to link, the member in their prefixes, and members enough before and after it.

    With all that two sets of these sizes must share known, their prefixes are shorter than those that were posted for partners of any size.
    """
    least = F.ceil((F.col("na") + F.col("nb")) * percent / F.lit(100.0 + percent))
    asked = F.least("needa", "needb")
    inside = (F.col("posa") + least < F.col("na") + asked) & (F.col("posb") + least < F.col("nb") + asked)
    most = F.least("posa", "posb") + F.least(F.col("na") - F.col("posa"), F.col("nb") - F.col("posb"))
    return (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent) & inside & (most >= least)


def _candidates(pairs: DataFrame, percent: int) -> DataFrame:
    """ka, kb and shared of the pairs, each given once for each prefix member, that share as many of these as one of the two asks for."""
    counted = pairs.where(_may_link(percent)).groupBy("ka", "kb").agg(F.count("*").alias("shared"), F.first(F.least("needa", "needb")).alias("asked"))
    return counted.where("shared >= asked").select("ka", "kb", "shared")


def _alike(percent: int) -> Column:
    return F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent


def _members(pairs: DataFrame, sets: DataFrame, texts: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """k, n and members of all classes of the pairs, read from their texts again."""
    wanted = pairs.select(F.col("ka").alias("k")).union(pairs.select("kb")).distinct()
    wanted = sets.select("k", "e", F.col("id").alias("want")).join(wanted, "k", "left_semi")
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("members", T.ArrayType(T.LongType()))])

    def read(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = shingle_sets(*reversed(offsets_and_bytes(batch.column("text"))), n)
        asked = batch.column("e").to_pylist()
        right = [k for k, s in enumerate(found) if set_name(s) == asked[k]]  # an id may stand for several texts
        some = [found[k] for k in right]
        return pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(right, pa.int64())), pa.array([len(s) for s in some], pa.int32()), _lists(some)], schema.names)

    asked = texts.join(if_small(saved(wanted, "ngram-wanted")), F.col("id").eqNullSafe(F.col("want"))).select("k", "e", "text")
    found = saved(map_texts(asked, read, schema), "ngram-members")
    # Rows of the same id and set are rare, so that they are looked for before the sets are dealt out for them.
    if found.groupBy("k").count().where("count > 1").limit(1).count():
        found = saved(found.dropDuplicates(["k"]), "ngram-members")
    return found


def _within_bundles(bundles: DataFrame, members: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """Links a, b, those of linked among them, that join all classes of a bundle that links of any of its pairs join."""
    whole, part = 100 + percent, 100 - percent
    pivots = members.select(F.col("k").alias("root"), F.col("members").alias("pivot"))
    both = bundles.select(F.col("node").alias("k"), "root").join(members, "k").join(pivots, "root")
    differ = both.select("root", "k", "n", F.concat(F.array_except("members", "pivot"), F.array_except("pivot", "members")).alias("differ"))
    differ = differ.withColumn("nd", F.size("differ")).withColumn("need", F.col("nd").cast("long") * whole - F.col("n").cast("long") * part)
    differ = saved(differ, "ngram-differ")
    least = differ.groupBy("root").agg(F.min(F.struct("need", "k")).alias("least"))
    heads = differ.select("root", "k", "n", "nd", "need").join(least, "root").select("*", F.col("least")["need"].alias("least_need"), F.col("least")["k"].alias("center")).drop("least")
    # Those that link with the class of least need are one part from the start.
    heads = saved(heads.withColumn("part", F.when(F.col("need") + F.col("least_need") <= 0, F.col("center")).otherwise(F.col("k"))), "ngram-heads")
    free = heads.where("k <> part").select(F.col("k").alias("a"), F.col("part").alias("b"))

    # Differences that stand alone in their bundle come first in the order, and only their number matters.
    each = differ.select("root", "k", F.explode("differ").alias("token"))
    counts = if_small(saved(each.groupBy("root", "token").agg(F.count("*").alias("times")).where("times > 1"), "ngram-counts"))
    common = each.join(counts, ["root", "token"]).groupBy("k").agg(F.sort_array(F.collect_list(F.struct("times", "token"))).alias("common"))  # no more than a text has members
    rare = F.col("nd") - F.size("common")
    least_shared = F.greatest(F.lit(1), F.ceil((F.col("need") + F.col("least_need")) / F.lit(2.0 * whole)))
    posted = heads.join(common, "k").select("root", "k", "nd", "need", "part", rare.alias("rare"), (F.col("nd") - least_shared).alias("last"), F.posexplode("common").alias("at", "member"))
    posted = posted.withColumn("pos", F.col("rare") + F.col("at")).where("pos <= last").select("root", F.col("member")["token"].alias("token"), "k", "nd", "need", "part", "pos")
    posted = saved(posted, "ngram-posted")

    # Those of other parts meet the class of least need of each of their lists first, the one they share most with.
    posted_now = _of_several(posted)
    lead = posted_now.groupBy("root", "token").agg(F.min(F.struct("need", "k", "part")).alias("lead"))
    pairs = posted_now.join(lead, ["root", "token"]).where(F.col("part") != F.col("lead")["part"])
    pairs = pairs.groupBy(F.col("k").alias("ka"), F.col("lead")["k"].alias("kb")).agg(F.count("*").alias("shared")).groupBy("ka").agg(F.max_by("kb", F.struct("shared", "kb")).alias("kb"))
    led = saved(free.union(linked).union(_verified(pairs, differ, whole)), "ngram-edges")

    # All pairs of different components that share a difference in the prefix of both, and can share as many as they need.
    roots = components(led, "ngram-led")
    found = roots.select(F.col("node").alias("k"), F.col("root").alias("found"))
    posted_now = saved(_of_several(posted.join(found, "k", "left").withColumn("part", F.coalesce("found", "k")).drop("found")), "ngram-several")
    a, b = (posted_now.select("root", "token", *(F.col(c).alias(c + s) for c in ("k", "nd", "need", "pos", "part"))) for s in "ab")
    asked = F.col("needa") + F.col("needb")
    most = (F.least("posa", "posb") + F.least(F.col("nda") - F.col("posa"), F.col("ndb") - F.col("posb"))) * 2 * whole
    prefixes = (2 * whole * (F.col("nda") - F.col("posa")) >= asked) & (2 * whole * (F.col("ndb") - F.col("posb")) >= asked)
    pairs = a.join(b, (a["root"] == b["root"]) & (a["token"] == b["token"]) & (F.col("ka") < F.col("kb")) & (F.col("parta") != F.col("partb")) & (asked > 0) & prefixes & (most >= asked))
    out = saved(led.union(_verified(pairs.select("ka", "kb").distinct(), differ, whole)), "ngram-links")
    release(differ, heads, posted, led, roots, posted_now)
    return out


def _of_several(posted: DataFrame) -> DataFrame:
    """The postings of lists whose classes are in several parts."""
    several = posted.groupBy("root", "token").agg(F.min("part").alias("lowest"), F.max("part").alias("highest")).where("lowest < highest").select("root", "token")
    return posted.join(several, ["root", "token"], "left_semi")


def _verified(pairs: DataFrame, differ: DataFrame, whole: int) -> DataFrame:
    """The pairs ka, kb whose differences share as many as they need, as links a, b."""
    pairs = saved(pairs, "ngram-candidates")
    a, b = (differ.select(F.col("k").alias("k" + s), F.col("need").alias("need" + s), F.col("differ").alias("d" + s)) for s in "ab")
    shared = F.size(F.array_intersect("da", "db"))
    found = pairs.join(a, "ka").join(b, "kb").where(F.col("needa") + F.col("needb") <= 2 * whole * shared)
    return found.select(F.col("ka").alias("a"), F.col("kb").alias("b"))

"""Spelling variants: a trie self-join with active-node sets over a prefix-partitioned vocabulary.

The vocabulary is counted in Spark. Words at distance one (one code point inserted, deleted or replaced) are
found in tries: the active nodes of a node are itself, at distance zero, and those at distance one, which come
into being where two branches of a node part (a replaced code point) or where one of them is skipped (an
inserted one). From there only equal code points keep a pair within the distance, so both nodes go down step
by step, and where both end a word the words are told.

Of two words at distance one of at least ``least`` code points, the first or the last (least - 1) // 2 code
points are equal: the vocabulary is therefore partitioned by such prefixes, once as it is and once reversed,
and each partition's trie goes down only from nodes below its prefix. A task goes through complete partitions,
about CHUNK words at a time. A prefix of more than CHUNK words is cut where its words first part, again and again;
the pairs that part at the node that was cut are met in Spark: they are equal behind it but for that code point.

Defined results: a null text has no words; a null identifier counts as an empty text in the edit's hash;
repeated rows count again; a word that is near none has no form and is its own root.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

#: Code points of a word and occurrences, at least; every so manyth occurrence loses a code point; a form's n is so many times the word's.
LEAST, OCCURRENCES, EDIT, TIMES = 7, 2, 31, 10
#: Words of a trie, about, and active pairs that are followed at once.
CHUNK, PAIRS = 50_000, 1_000_000


def edited_words(docs: DataFrame, least: int = LEAST, edit: int = EDIT) -> DataFrame:
    """word, one row an occurrence: runs of letters, some of them without one code point."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(r"([a-zÀ-ÿ]{%d,})" % least), F.lit(1))
    rows = docs.select(doc_id.alias("doc_id"), F.explode(runs).alias("run"))
    rows = rows.withColumn("h", F.crc32(F.concat("doc_id", F.lit(":"), "run").cast("binary")))
    at = F.expr("CAST(h % length(run) AS INT)")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return rows.select(F.when(F.col("h") % edit == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.length("word") >= least)


def vocabulary(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, edit: int = EDIT) -> DataFrame:
    """word, n of each distinct word."""
    return edited_words(docs, least, edit).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= occurrences)


class Trie:
    """Nodes of sorted words as arrays; a node's children lie side by side, in order of their code points."""

    def __init__(self, words: list[str]):
        parent, char, depth, ends, maker = [-1], [0], [0], [-1], [0]
        path, before = [0], ""  # the nodes of the word before, by depth
        for at, word in enumerate(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                parent.append(path[-1]), char.append(ord(c)), depth.append(len(path)), ends.append(-1), maker.append(at)
                path.append(len(parent) - 1)
            ends[path[-1]] = at
            before = word
        self.parent, self.char, self.depth, self.ends, self.maker = map(np.array, (parent, char, depth, ends, maker))
        self.child = np.argsort(self.parent, kind="stable")[1:]  # behind the root; nodes were made in order of their words
        self.edges = (self.parent[self.child] << 21) | self.char[self.child]
        self.count = np.bincount(self.parent[1:], minlength=len(parent))
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]])

    def children(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All children of the nodes, the place of the node each belongs to, and how many of them are left from it on."""
        count = self.count[nodes]
        place = np.repeat(np.arange(len(nodes)), count)
        within = np.arange(len(place)) - np.repeat(np.cumsum(count) - count, count)
        return self.child[self.first[nodes][place] + within], place, count[place] - within

    def step(self, one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The children of the pairs of nodes that go on by the same code point."""
        swap = self.count[one] > self.count[other]
        below, place, _ = self.children(np.where(swap, other, one))
        edge = (np.where(swap, one, other)[place] << 21) | self.char[below]
        at = np.minimum(np.searchsorted(self.edges, edge), len(self.edges) - 1)
        met = np.flatnonzero(self.edges[at] == edge)
        below, beside, swap = below[met], self.child[at[met]], swap[place[met]]
        return np.where(swap, beside, below), np.where(swap, below, beside)

    def near(self, least_depth: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of words at distance one that part at a node as deep as its first word's ``least_depth`` or deeper."""
        nodes = np.flatnonzero((self.depth >= least_depth[self.maker]) & (self.count > 0))
        room = np.cumsum(self.count[nodes] * (self.count[nodes] + 1) // 2)
        for some in np.split(nodes, np.searchsorted(room, np.arange(PAIRS, room[-1], PAIRS)) if len(nodes) else []):
            below, place, left = self.children(some)
            beside = some[place]
            # a branch beside its own node is an inserted code point; where the next one is the same, they part further down
            yield self.ends[beside], self.ends[below]
            one, other = self.step(beside, below)
            parted = self.char[one] != self.char[self.parent[other]]
            active = [(one[parted], other[parted])]
            at, ahead = np.arange(len(below)), 1
            while len(at := at[left[at] > ahead]):  # two branches are a replaced one
                active.append((below[at], below[at + ahead]))
                ahead += 1
            one, other = (np.concatenate(x) for x in zip(*active, strict=True))
            while len(one):
                yield self.ends[one], self.ends[other]
                one, other = self.step(one, other)


def trie_pairs(parts: DataFrame) -> DataFrame:
    """one, one_n, other, other_n: words at distance one of a partition (prefix, depth, word, n) that part at ``depth`` or deeper."""
    parts = parts.repartition("prefix").sortWithinPartitions("word")

    def told(words: list[str], depths: list[int], n: np.ndarray) -> Iterator[pa.RecordBatch]:
        named, trie = pa.array(words, pa.string()), Trie(words)
        for a, b in trie.near(np.array(depths)):
            both = np.flatnonzero((a >= 0) & (b >= 0))
            if len(both):
                a, b = a[both], b[both]
                yield pa.RecordBatch.from_arrays([named.take(pa.array(a)), pa.array(n[a]), named.take(pa.array(b)), pa.array(n[b])], names=["one", "one_n", "other", "other_n"])

    def walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, depths, counts, last = [], [], [], None
        for batch in batches:
            for prefix, depth, word, n in zip(*[batch.column(c).to_pylist() for c in ("prefix", "depth", "word", "n")], strict=True):
                if len(words) >= CHUNK and prefix != last:
                    yield from told(words, depths, np.array(counts))
                    words, depths, counts = [], [], []
                words.append(word), depths.append(depth), counts.append(n)
                last = prefix
        if words:
            yield from told(words, depths, np.array(counts))

    return parts.select("prefix", "depth", "word", "n").mapInArrow(walked, "one string, one_n bigint, other string, other_n bigint")


def parted_pairs(under: DataFrame) -> DataFrame:
    """Words (word, n, node: how many code points all words of its prefix share) at distance one that part there: they are equal behind it but for a code point."""
    at, size = F.col("node"), F.length("word")
    at = under.select(F.substring("word", F.lit(1), at).alias("stem"), "word", "n", F.substring("word", at + 1, F.lit(1)).alias("c"), F.substring("word", at + 1, size).alias("whole"), F.substring("word", at + 2, size).alias("rest"))
    skipped = at.filter("c <> ''").select("stem", "rest", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("c").alias("its"))
    replaced = at.filter("c <> ''").select("stem", "rest", F.col("word").alias("one"), F.col("n").alias("one_n"), "c", F.lit(True).alias("same"))
    kept = at.select("stem", F.col("whole").alias("rest"), F.col("word").alias("one"), F.col("n").alias("one_n"), "c", F.lit(False).alias("same"))
    both = skipped.join(replaced.unionByName(kept), ["stem", "rest"])
    return both.filter("c <> its AND (NOT same OR one < other)").select("one", "one_n", "other", "other_n")


def one_way(words: DataFrame, shared: int, chunk: int) -> DataFrame:
    """Pairs at distance one of words (word, n) whose first ``shared`` code points are equal."""
    parts = words.select("word", "n", F.substring("word", 1, shared).alias("prefix"), F.lit(shared).alias("depth"), F.lit(True).alias("cut"))
    pairs = []
    # all words of a prefix begin as its first and its last word do, so nothing parts before that
    equal = F.expr("aggregate(sequence(1, least(length(low), length(high))), 0, (acc, i) -> IF(acc = i - 1 AND substring(low, i, 1) = substring(high, i, 1), i, acc))")
    while True:
        wide = parts.filter("cut").groupBy("prefix").agg(F.count("*").alias("many"), F.min("word").alias("low"), F.max("word").alias("high"))
        wide = stored(wide.filter(F.col("many") > chunk).select("prefix", equal.alias("node")), "variants-wide")
        if wide.isEmpty():
            break
        parts = stored(parts.drop("cut").join(wide, "prefix", "left"), "variants-parts")
        pairs.append(parted_pairs(parts.filter("node is not null")))
        deeper = F.col("node").isNotNull()
        prefix = F.when(deeper, F.substring("word", F.lit(1), F.col("node") + 1)).otherwise(F.col("prefix"))
        parts = parts.select("word", "n", prefix.alias("prefix"), F.coalesce(F.col("node") + 1, "depth").alias("depth"), deeper.alias("cut"))
    found = trie_pairs(parts)
    for some in pairs:
        found = found.unionByName(some)
    return found


def near_words(words: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """word, n, near, near_n: all pairs of words (word, n) of ``least`` code points or more at distance one, both ways round."""
    shared = (least - 1) // 2
    if shared < 1:
        raise ValueError("words of fewer than three code points share no prefix or suffix for sure")
    start = lambda c: F.substring(c, 1, shared)
    forward = one_way(words, shared, chunk)
    turned = one_way(words.withColumn("word", F.reverse("word")), shared, chunk)
    turned = turned.withColumn("one", F.reverse("one")).withColumn("other", F.reverse("other")).filter(start("one") != start("other"))
    pair = lambda a, b: F.struct(F.col(a).alias("word"), F.col(f"{a}_n").alias("n"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    return forward.unionByName(turned).select(F.inline(F.array(pair("one", "other"), pair("other", "one"))))


def roots(forms: DataFrame) -> DataFrame:
    """word, root: forms (word, form) followed to the last. n grows from form to form, so few steps end it."""
    now = forms.select("word", F.col("form").alias("root"))
    done = []
    while True:
        on = stored(now.join(forms.toDF("root", "next"), "root", "left"), "variants-roots")
        done.append(on.filter("next is null").select("word", "root"))
        now = on.filter("next is not null").select("word", F.col("next").alias("root"))
        if now.isEmpty():
            break
    ended = done[0]
    for more in done[1:]:
        ended = ended.unionByName(more)
    return ended


def variant_report(docs: DataFrame, least: int = LEAST, occurrences: int = OCCURRENCES, edit: int = EDIT, times: int = TIMES, chunk: int = CHUNK) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the vocabulary."""
    words = stored(vocabulary(docs.select("doc_id", "text"), least, occurrences, edit), "variants-words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near")))
    each = near_words(words, least, chunk).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    each = each.select("word", "n", "n_near", F.when(-F.col("best.less") >= times * F.col("n"), F.col("best")).alias("best"))
    each = stored(each.select("word", "n_near", F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")), "variants-near")
    last = roots(each.filter("form is not null").select("word", "form"))
    found = words.join(each, "word", "left").join(last, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")

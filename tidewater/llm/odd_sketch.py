"""MinHash near-dedup with odd sketches.

A document's set holds the distinct shingles of SHINGLE words. SAMPLES MinHash values are taken of each
set; BANDS bands of ROWS values are the keys over which sets meet, and all samples are folded into an odd
sketch: a bitmap of SKETCH bits in which each (sample, value) flips one bit. Two sketches differ in few bits
if the sets are alike, the more precisely the more alike they are, so the population count of their XOR tells
which of the sets that meet are worth a look at the texts. What is linked in the end is decided on the full sets.

Sets meet in two rounds, so that a group of very many copies never becomes all its pairs: first each set
with the least one of its bucket (one pair a member); links that the full sets confirm join into components.
Then only buckets that still hold several components are gone through, wide ones cut into blocks, a task a pair
of blocks: the sets that look like one of another component have their overlaps counted there, all at once as
products of matrices, and what is told are links that join components, not pairs that were compared. Every two
sets of one bucket are therefore linked, known to be connected, or compared. What can be lost is a pair that shares
no band (at a likeness of 0.85 seven of a million) or whose sketches differ too much (less than one of a million).

Defined results: texts of equal sets are one node, however many there are; a null, empty or blank text has an
empty set and is linked with nothing, its component is its own identifier; repeated rows are in one component;
null identifiers are kept out of component ids where a group has others, and a row is kept where doc_id
and component_id are equal, both null too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, marked_by, stored
from .simhash import components
from .substring_dedup import mixed, window_keys

SHINGLE = 3
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 85
SAMPLES, BANDS, ROWS = 128, 20, 5
#: Bits of a sketch, and how many of them may differ: two for each differing sample at most, of which sets at
#: the limit have 19 on average and above 40 in less than one case of a million.
SKETCH, MAX_ODD = 512, 80
#: Members and tokens of a block of a wide bucket, and tokens that are multiplied at once.
BLOCK, BLOCK_TOKENS, WIDTH = 2048, 4_000_000, 4096

_SEEDS = mixed(np.arange(1, 2 * SAMPLES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES, _PLUS = _SEEDS[:SAMPLES, None] | np.uint64(1), _SEEDS[SAMPLES:, None]
_PLACE = np.arange(1, SAMPLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles as sorted 64-bit keys; of a shorter text the whole sequence."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six blanks only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    return np.unique(window_keys(hashes, min(shingle, len(words))))


def samples(keys: np.ndarray) -> np.ndarray:
    """The least value of a set under each of SAMPLES hash functions."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(keys), 1024):
        np.minimum(least, (keys[None, at : at + 1024] * _TIMES + _PLUS).min(1), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    parts = mixed(least[: BANDS * ROWS] + _PLACE[: BANDS * ROWS]).reshape(BANDS, ROWS)
    return mixed(parts.sum(1, dtype=np.uint64) + _PLACE[:BANDS])


def odd_sketch(least: np.ndarray) -> np.ndarray:
    """A bitmap in which a bit is set if an odd number of samples fall on it."""
    bits = np.bincount((mixed(least ^ _PLACE) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<u8")


def estimate(odd: float) -> float:
    """The likeness that sketches differing in so many bits speak of."""
    return max(0.0, 1 + SKETCH * np.log(max(1 - 2 * odd / SKETCH, 1e-9)) / (4 * SAMPLES))


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, content (digest of the text), n_shingles, set_key (null: empty set), keys, sketch of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2("text", 256).alias("content"), "text")

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sets, keys, sketches = [], [], [], []
            for text in batch.column("text"):
                found = shingle_set(text.as_py(), shingle)
                n.append(len(found))
                if len(found):
                    least = samples(found)
                    sets.append(xxhash.xxh3_128_digest(found.tobytes()))
                    keys.append(band_keys(least).view(np.int64))
                    sketches.append(odd_sketch(least).view(np.int64))
                else:
                    sets.append(None), keys.append(None), sketches.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("content"), pa.array(n, pa.int64()), pa.array(sets, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                names=["doc_id", "content", "n_shingles", "set_key", "keys", "sketch"],
            )

    return rows.mapInArrow(signed, "doc_id bigint, content string, n_shingles bigint, set_key binary, keys array<bigint>, sketch array<bigint>")


def odd_bits(one: Column, other: Column) -> Column:
    """In how many bits two sketches differ."""
    return F.aggregate(F.zip_with(one, other, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)


def alike(pairs: DataFrame, nodes: DataFrame, max_odd: int = MAX_ODD) -> DataFrame:
    """Those of the pairs one, other (nodes) whose sketches differ in few bits."""
    of = nodes.select("node", "sketch")
    both = pairs.join(of.toDF("other", "sketch"), "other").join(of.toDF("one", "its"), "one")
    return both.filter(odd_bits(F.col("sketch"), F.col("its")) <= max_odd).select("one", "other")


def texts_of(some: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """node, text of some nodes (node, distinct); only texts of these are shuffled, one of each."""
    wanted = stored(some.join(nodes.select("node", "content"), "node"), "odd-wanted")
    texts = docs.select(F.sha2("text", 256).alias("content"), "text")
    texts = marked_by(texts, "content", hash_filter(wanted, "content")).filter("may").groupBy("content").agg(F.first("text").alias("text"))
    return wanted.join(texts, "content").select("node", "text")


def confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs whose full sets are alike."""
    texts = stored(texts_of(pairs.select(F.explode(F.array("one", "other")).alias("node")).distinct(), nodes, docs), "odd-texts")
    both = pairs.join(texts.toDF("other", "text"), "other").join(texts.toDF("one", "its"), "one")

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, mine = None, None
        for batch in batches:
            kept = []
            for i, (one, its, text) in enumerate(zip(*[batch.column(c) for c in ("one", "its", "text")], strict=True)):
                if known != one.as_py():  # rows of one node follow each other
                    known, mine = one.as_py(), shingle_set(its.as_py(), shingle)
                found = shingle_set(text.as_py(), shingle)
                shared = len(np.intersect1d(mine, found, assume_unique=True))
                if 100 * shared >= percent * (len(mine) + len(found) - shared):
                    kept.append(i)
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("one").take(at), batch.column("other").take(at)], names=["one", "other"])

    return both.select("one", "other", "its", "text").mapInArrow(held, "one bigint, other bigint")


def with_tokens(texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """node, tokens: 32 bits of each shingle's key."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [(shingle_set(t.as_py(), shingle) >> np.uint64(32)).astype(np.uint32).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    return texts.select("node", "text").mapInArrow(cut, "node bigint, tokens binary")


def overlaps(tokens: list[np.ndarray]) -> np.ndarray:
    """How many tokens each two have in common; where tokens of one are equal, rather too many than too few."""
    row = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
    _, name, often = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    row, name = row[often[name] > 1], (np.cumsum(often > 1) - 1)[name[often[name] > 1]]  # what one alone has is in no overlap
    total, order = np.zeros((len(tokens), len(tokens)), np.float32), np.argsort(name, kind="stable")
    row, name = row[order], name[order]
    for start in range(0, int(name[-1]) + 1 if len(name) else 0, WIDTH):
        some = slice(*np.searchsorted(name, (start, start + WIDTH)))
        here = np.bincount(row[some] * WIDTH + name[some] - start, minlength=len(tokens) * WIDTH).reshape(-1, WIDTH).astype(np.float32)
        total += here @ here.T
    return total


def linked_across(nodes: np.ndarray, roots: np.ndarray, sketches: np.ndarray, tokens: list[np.ndarray], percent: int = PERCENT, max_odd: int = MAX_ODD) -> list[tuple[int, int]]:
    """Links between different roots of one bucket, enough to join the roots that any two of its nodes link.

    Only nodes with a sketch like that of a node of another root are looked at.
    """
    at = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1):
        alike_ = (np.bitwise_count(sketches[i] ^ sketches[i + 1 :]).sum(1) <= max_odd) & (roots[i + 1 :] != roots[i])
        at[i + 1 :] |= alike_
        at[i] |= alike_.any()
    if not at.any():
        return []
    at = np.flatnonzero(at)
    tokens, roots, size = [tokens[i] for i in at], roots[at].tolist(), np.array([len(tokens[i]) for i in at])
    shared = overlaps(tokens)
    hits = np.argwhere(np.triu(100 * shared >= percent * (size[:, None] + size - shared), 1))
    root, found = {r: r for r in roots}, []

    def top(r: int) -> int:
        while root[r] != r:
            root[r] = r = root[root[r]]
        return r

    for a, b in hits.tolist():
        if (x := top(roots[a])) != (y := top(roots[b])):
            root[x] = y
            found.append((int(nodes[at[a]]), int(nodes[at[b]])))
    return found


def met_across(members: DataFrame, percent: int = PERCENT, max_odd: int = MAX_ODD, block: int = BLOCK, tokens: int = BLOCK_TOKENS) -> DataFrame:
    """one, other: links between different roots among each key's members (key, n, all, node, root, sketch, tokens).

    Keys of more than ``block`` members or ``tokens`` tokens (n and all) are cut into blocks of about so many, and
    a member goes along with each other block of its key, so a group has twice ``block`` members or tokens at most.
    """
    blocks = F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("all") / tokens)).cast("int")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.withColumn("blocks", blocks).withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    # a group's number is a hash: where two groups share one, their members are only compared once more
    dealt = dealt.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("met"), "node", "root", "sketch", "tokens")
    dealt = dealt.repartition("met").sortWithinPartitions("met", "node")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            rest = table if rest is None else pa.concat_tables([rest, table])
            groups = rest.column("met").to_numpy()
            cut = int(np.searchsorted(groups, groups[-1]))  # the last group may go on in the next batch
            if cut:
                yield told(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None:
            yield told(rest)

    def told(table: pa.Table) -> pa.RecordBatch:
        groups, nodes, roots = (table.column(c).to_numpy() for c in ("met", "node", "root"))
        sketches = table.column("sketch").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(groups), -1)
        held = table.column("tokens").combine_chunks()
        ends, found = [*np.flatnonzero(groups[1:] != groups[:-1]) + 1, len(groups)], []
        for first, last in zip([0, *ends[:-1]], ends, strict=True):
            some = slice(int(first), int(last))
            if len(np.unique(roots[some])) > 1:
                found += linked_across(nodes[some], roots[some], sketches[some], [np.frombuffer(held[i].as_buffer(), np.uint32) for i in range(some.start, some.stop)], percent, max_odd)
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["one", "other"])

    return dealt.mapInArrow(met, "one bigint, other bigint").select(F.least("one", "other").alias("one"), F.greatest("one", "other").alias("other")).distinct()


def links(nodes: DataFrame, docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, max_odd: int = MAX_ODD, block: int = BLOCK) -> DataFrame:
    """one, other: confirmed links of nodes (node, content, size, keys, sketch), enough to join all that are linked."""
    keyed = stored(nodes.select("node", "size", F.explode("keys").alias("key")), "odd-keys")
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("all"), F.min("node").alias("one")).filter("n > 1")
    shared = stored(keyed.join(buckets, "key").select("key", "n", "all", "one", "node"), "odd-buckets")
    starred = stored(alike(shared.filter("node <> one").select("one", F.col("node").alias("other")).distinct(), nodes, max_odd), "odd-stars")
    linked = stored(confirmed(starred, nodes, docs, shingle, percent), "odd-links")
    rooted = shared.join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = stored(rooted.select("key", "n", "all", "node", "root"), "odd-rooted")
    several = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("key")
    members = stored(rooted.join(several, "key"), "odd-members")
    full = with_tokens(texts_of(members.select("node").distinct(), nodes, docs), shingle).join(nodes.select("node", "sketch"), "node")
    across = stored(met_across(members.join(stored(full, "odd-tokens"), "node"), percent, max_odd, block), "odd-across")
    return linked.unionByName(confirmed(across, nodes, docs, shingle, percent))


def odd_sketch_report(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, max_odd: int = MAX_ODD, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    docs = docs.select("doc_id", "text")
    rows = stored(signatures(docs, shingle), "odd-rows")
    sets = rows.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("low"), F.min("content").alias("content"), F.first("n_shingles").alias("size"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch"))
    nodes = stored(sets.withColumn("node", F.monotonically_increasing_id()), "odd-nodes")  # stored: numbers stay as they are
    of = components(links(nodes, docs, shingle, percent, max_odd, block))
    rooted = nodes.select("set_key", "low", "node").join(of, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("set_key", "component_id")
    named = stored(named, "odd-named")
    found = rows.select("doc_id", "n_shingles", "set_key")
    linked = found.filter("set_key is not null").join(named, "set_key").select("doc_id", "n_shingles", "component_id")
    alone = found.filter("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

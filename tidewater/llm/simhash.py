"""SimHash near-dedup over deletion-variant signatures.

Fingerprints of MAX_BITS or fewer differing bits are linked. Cut into SEGMENTS segments, two such
fingerprints differ by at most one bit in one of them, so they share that segment with one bit position
left out. Every distinct fingerprint is indexed by each segment with each one of its bits left out;
fingerprints meet by equality of such a key and are verified on all bits. What is emitted of the
fingerprints of a key is a spanning forest of their verified links (all links of up to SMALL), not all
pairs, so a group of very many copies gives as many rows as it has members. Where more than RUN
fingerprints share a key they are not compared there: their other bits are cut into segments again and
meet by the pair of keys, which loses no link for the same reason.

The pipeline's near-copies are those of five-word shingles with a similarity of about 0.8 or more:
near_prints() has a 64-bit fingerprint of them, verified to NEAR_BITS bits, and the segments of a longer
fingerprint of word pairs, of which few bits change between such texts; a pair is met with a chance that
grows with its similarity, not for certain.

Defined results: a null text counts as empty; an empty text has fingerprint zero and is linked like any
other; repeated rows and equal texts have equal fingerprints and so one component; null identifiers are
kept out of component ids where a group has others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .substring_dedup import mixed, window_keys

MAX_BITS = 4
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 4
#: Fingerprints of a key that one task compares, and those of which it compares all pairs at once.
RUN, SMALL = 4096, 8
#: Near copies: words of a shingle, differing bits at most (two texts with 0.8 of their shingles in common
#: have 10 on average), and the segments of word pairs' fingerprint: lanes of 64 bits, two segments of each.
NEAR_SHINGLE, NEAR_BITS, LANES, LANE_SEGMENTS = 5, 12, 4, ((0, 24), (24, 24))


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of word shingles (XXH64, seed 42; repeats count)."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z only, and the six blanks only
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(line, 42)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        hashes = [xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    h = np.array(hashes, np.uint64)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * votes > len(h)).astype(np.uint8), bitorder="little").view("<u8")[0])


def with_fingerprints(df: DataFrame, carried: list[str], shingle: int = SHINGLE) -> DataFrame:
    """A struct ``row`` of the carried columns, and the fingerprint as a signed 64-bit number."""
    own = "text" in carried  # the text then travels once
    rows = df.select(F.struct(*[F.col(c) for c in carried]).alias("row"), *([] if own else ["text"]))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field(carried.index("text")) if own else batch.column("text")
            prints = np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(prints.view(np.int64))], names=["row", "fp"])

    return rows.mapInArrow(hashed, f"row {rows.schema['row'].dataType.simpleString()}, fp bigint")


def _votes(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit fingerprint for each column of hashes."""
    votes = np.zeros(64 * hashes.shape[1], np.int64)
    for at in range(0, len(hashes), 1 << 14):
        some = np.ascontiguousarray(hashes[at : at + (1 << 14)])
        votes += np.unpackbits(some.view(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return np.packbits((2 * votes > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")


def near_prints(text: str | None) -> np.ndarray:
    """The fingerprint of a text's distinct five-word shingles, then LANES fingerprints of its distinct word pairs."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(1 + LANES, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    grams, pairs = (np.unique(window_keys(hashes, min(n, len(words)))) for n in (NEAR_SHINGLE, 2))
    seeds = np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.concatenate([_votes(grams[:, None]), _votes(mixed(pairs[:, None] + seeds))])


def with_near_prints(df: DataFrame, carried: list[str]) -> DataFrame:
    """A struct ``row`` of the carried columns (text among them), fp, and lanes array<bigint> of each row."""
    rows = df.select(F.struct(*[F.col(c) for c in carried]).alias("row"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [near_prints(t.as_py()).view(np.int64) for t in batch.column("row").field(carried.index("text"))]
            prints, lanes = pa.array([x[0] for x in told], pa.int64()), pa.array([x[1:] for x in told], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("row"), prints, lanes], names=["row", "fp", "lanes"])

    return rows.mapInArrow(hashed, f"row {rows.schema['row'].dataType.simpleString()}, fp bigint, lanes array<bigint>")


def _keys(parts: list[tuple[Column, int, int]], *within: Column) -> Column:
    """The keys of segments (number, first bit, bits) with one bit left out: a hash below the segment's place in the list."""
    keys = []
    for place, (bits, start, width) in enumerate(parts):
        segment = ((1 << width) - 1) << start
        for i in range(width):
            mask = segment & ~(1 << (start + i))
            part = bits.bitwiseAND(F.lit(mask if mask < 1 << 63 else mask - (1 << 64)))
            keys.append(F.xxhash64(*within, F.lit(64 * place + i), part).bitwiseAND(F.lit((1 << 60) - 1)).bitwiseOR(F.lit(place << 60)))
    return F.array(*keys)


def forest(prints: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links that join what verified links join: each print is compared with those not reached so far."""
    left, edges, todo = prints, [], []
    while len(left) or todo:
        if not todo:
            todo, left = [left[0]], left[1:]
        one = todo.pop()
        near = np.bitwise_count(left ^ one) <= max_bits
        if near.any():
            edges += [(one, x) for x in left[near]]
            todo += list(left[near])
            left = left[~near]
        elif not len(left):
            break
    return edges


def _linked_runs(keys: np.ndarray, prints: np.ndarray, max_bits: int) -> np.ndarray:
    """Links within each run of equal keys: all of small runs, a forest of larger ones."""
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.concatenate([first, [len(keys)]]))
    small, found = np.repeat(size <= SMALL, size), [np.empty((0, 2), np.uint64)]
    for step in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:]))
        if not len(at):
            break
        at = at[np.bitwise_count(prints[at] ^ prints[at + step]) <= max_bits]
        found.append(np.stack([prints[at], prints[at + step]], 1))
    for at, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        found.append(np.array(forest(np.unique(prints[at : at + n]), max_bits), np.uint64).reshape(-1, 2))
    return np.concatenate(found)


def _met(keyed: DataFrame, max_bits: int, run: int | None) -> DataFrame:
    """one, other: verified links of what shares a key (key, fp); of keys with more than ``run`` members their fp as one, and the key as wide."""
    keyed = keyed.repartition("key").sortWithinPartitions("key", "fp")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_k, rest_p, wide = np.empty(0, np.int64), np.empty(0, np.uint64), None

        def linked(k, p):
            if not len(k):
                return
            pairs = np.unique(_linked_runs(k, p, max_bits), axis=0).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), pa.nulls(len(pairs), pa.int64())], names=["one", "other", "wide"])

        def put_off(k, p):
            if len(k):
                yield pa.RecordBatch.from_arrays([pa.array(p.view(np.int64)), pa.nulls(len(k), pa.int64()), pa.array(k)], names=["one", "other", "wide"])

        for batch in batches:
            if not batch.num_rows:
                continue
            k = np.concatenate([rest_k, batch.column("key").to_numpy(zero_copy_only=False)])
            p = np.concatenate([rest_p, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if run is not None:  # members of runs beyond the bound go on as they come
                first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
                size = np.diff(np.concatenate([first, [len(k)]]))
                over = np.repeat((size > run) | (k[first] == wide if wide is not None else False), size)
                yield from put_off(k[over], p[over])
                wide = k[-1] if over[-1] else None
                k, p = k[~over], p[~over]
            cut = int(np.searchsorted(k, k[-1])) if len(k) and wide is None else len(k)  # the last key may go on in the next batch
            rest_k, rest_p = k[cut:], p[cut:]
            yield from linked(k[:cut], p[:cut])
        yield from linked(rest_k, rest_p)

    return keyed.mapInArrow(met, "one bigint, other bigint, wide bigint")


def links(prints: DataFrame, max_bits: int = MAX_BITS, run: int = RUN) -> DataFrame:
    """one, other: links between distinct fingerprints (column fp), enough to join all that are linked."""
    if max_bits >= 2 * len(SEGMENTS):
        raise ValueError("with so many bits two fingerprints may differ by two bits in every segment")
    fp = F.col("fp")
    found = stored(_met(prints.select("fp", F.explode(_keys([(fp, *x) for x in SEGMENTS])).alias("key")), max_bits, run), "simhash-met")
    linked, wide = found.filter("wide is null").select("one", "other"), found.filter("wide is not null").select(F.col("one").alias("fp"), "wide")
    if not wide.isEmpty():
        # a key's segment is its place; the other bits side by side, cut into as many segments
        others = F.lit(None).cast("long")
        for place, (start, width) in enumerate(SEGMENTS):
            low, high = F.col("fp").bitwiseAND(F.lit((1 << start) - 1)), F.shiftrightunsigned("fp", start + width) if start + width < 64 else F.lit(0).cast("long")
            others = F.when(F.shiftright("wide", 60) == place, F.shiftleft(high, start).bitwiseOR(low)).otherwise(others)
        cut = [(F.col("others"), 0, 14), (F.col("others"), 14, 14), (F.col("others"), 28, 15)]
        again = wide.withColumn("others", others).select("fp", F.explode(_keys(cut, F.col("wide"))).alias("key"))
        linked = linked.unionByName(_met(again, max_bits, None).select("one", "other"))
    return linked.distinct()


def near_links(prints: DataFrame, max_bits: int = NEAR_BITS) -> DataFrame:
    """one, other: verified links of fingerprints (fp) that share a segment of their word pairs (lanes) but for a bit."""
    keys = _keys([(F.get("lanes", F.lit(i)), *x) for i in range(LANES) for x in LANE_SEGMENTS])
    return _met(prints.select("fp", F.explode(keys).alias("key")), max_bits, None).select("one", "other").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of each component of the edges one, other.

    Alternating large-star and small-star steps; each step is stored, so none is computed twice.
    """
    now = edges.select(F.greatest("one", "other").alias("a"), F.least("one", "other").alias("b")).filter("a <> b").distinct()
    now = stored(now, "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).filter("a <> b").distinct()
        then = stored(small, "links")
        same = now.count() == then.count() and now.exceptAll(then).isEmpty()
        now = then
        if same:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))


def named_groups(rows: DataFrame, linked: Callable[[DataFrame], DataFrame], *lanes: str) -> DataFrame:
    """fp, root, component_id of every fingerprint of the rows (fp, doc_id, lanes)."""
    least = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), *[F.min(c).alias(c) for c in lanes]), "simhash-prints")
    of = stored(components(linked(least.select("fp", *lanes))).withColumnRenamed("node", "fp"), "simhash-roots")
    rooted = least.select("fp", "low").join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    per_root = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return stored(rooted.join(per_root, "root").select("fp", "root", "component_id"), "simhash-named")


def near_dup_report(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    rows = with_fingerprints(docs.select("doc_id", "text"), ["doc_id"])
    rows = stored(rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "fp"), "simhash-rows")
    named = named_groups(rows, lambda prints: links(prints, max_bits))
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_dedup(docs: DataFrame, max_bits: int = NEAR_BITS) -> DataFrame:
    """One document of each group of near copies, the one with the smallest identifier, with its own columns."""
    rows = stored(with_near_prints(docs, docs.columns), "simhash-rows").withColumn("doc_id", F.col("row.doc_id").cast("long"))
    named = named_groups(rows, lambda prints: near_links(prints, max_bits), "lanes")
    placed = rows.withColumn("place", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")))
    # the place of each group's row, found without the texts, which are then shuffled once
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")
    kept = placed.select("fp", "doc_id", "place").join(named, "fp").groupBy("root").agg(F.min(first).alias("kept")).select("kept.place")
    return placed.select("place", "row").join(kept, "place").select(*[F.col(f"row.{c}").alias(c) for c in docs.columns])

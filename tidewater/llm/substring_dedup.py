"""Substring dedup by level-wise doubling over word windows.

Every start of a window of the base length is a candidate. At each level the candidates' windows are
compared over the whole corpus; those that start nowhere else go, and the rest are extended to twice
the length (at most to the window asked for): a longer window's key is the pair of keys of the two
shorter ones that cover it, so a start survives to be compared again only if both were repeated. This
ends at the full length; a block of documents without candidates left sends nothing more.

Candidates travel in packs: a block of documents sends, for each bucket of keys, one row with the keys
and starts; a window that a block holds several times is sent once, marked as repeated. A block's list of
documents goes with the pack of one bucket, a different one for each block.

Keys stand for words. A key of the base length has ``width`` bytes besides its bucket, chosen from the number
of words so that few windows go on without need; a longer one is mixed from the two it is put together from, to
8 bytes, and to 12 at the full length, besides its bucket. So a wrong removal needs different windows of equal
keys: for two that differ in one base window only the chance is 2 ** -(8 * width) over the number of buckets (2 ** -38
or less), for any others 2 ** -64 or less at a level between and 2 ** -96 in the end.

Defined results: a null text has no words; rows are judged one by one, repeated rows too, so two rows
of one text remove each other's windows; texts shorter than a window lose nothing. Rows are numbered in
the order of the scan, so docs should be a table as read or stored, which a lost task reads alike.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_filter, marked_by, stored

WINDOW = 35
#: The shortest windows that are compared have so many words, or up to twice as many.
BASE = 9
#: Words of a block (the documents that one row of packs stands for) and of a bucket, about.
BLOCK_WORDS, BUCKET_WORDS = 1_000_000, 3_000_000

PACK = "block bigint, bucket int, width int, keys binary, starts binary, many binary, docs binary"


def levels(window: int) -> list[int]:
    """Window lengths, each at most twice the one before it, up to the window: halves of it down to BASE or more."""
    out = [window]
    while (out[0] + 1) // 2 >= BASE:
        out.insert(0, (out[0] + 1) // 2)
    return out


def split_words(text: str | None) -> list[bytes]:
    """Words unchanged; bytes.split() parts at the six ASCII blanks only."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_keys(hashes: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit key of each window of so many word hashes, put together by doubling."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    base = np.uint64(0x9E3779B97F4A7C15)
    power, span, run = base, 1, hashes
    key, done = None, 0
    rest = length
    with np.errstate(over="ignore"):
        while rest:
            if rest & 1:
                part = run[done : done + n]
                if key is None:
                    key = part.copy()
                else:
                    key = key * power + part
                done += span
            rest >>= 1
            if rest:
                run = run[: len(run) - span] * power + run[span:]
                power = power * power
                span *= 2
        return mixed(key)


def _pressed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as differences, bytes of equal weight together, pressed."""
    steps = np.diff(numbers.astype(np.uint32), prepend=np.uint32(0))
    return zstandard.ZstdCompressor(level=1).compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes())


def _restored(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint32).astype(np.int64)


def _by_first_start(keys: np.ndarray, starts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, bytes, bytes]:
    """Of keys in order (first: the first of equal ones): distinct keys by their first start, all starts, and how many each has."""
    at = np.flatnonzero(first)
    size = np.diff(np.concatenate([at, [len(keys)]]))
    order = np.argsort(starts[at], kind="stable")
    at, size = at[order], size[order]
    if len(at) < len(keys):
        flat = np.repeat(at - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(len(keys))
        return keys[at], _pressed(starts[flat]), size.astype(np.int32).tobytes()
    return keys[at], _pressed(starts[at]), b""


def _home(block: int, n_buckets: int) -> int:
    """The bucket whose pack takes a block's documents along."""
    return ((block >> 32) * 31 + (block & 0xFFFFFFFF)) % n_buckets


def _packs(block: int, keys: np.ndarray, starts: np.ndarray, n_buckets: int, width: int, docs: bytes) -> pa.RecordBatch:
    """One row a bucket: distinct keys of the block with a start each, then what starts share a key."""
    bucket = (mixed(keys) >> np.uint64(20)) % np.uint64(n_buckets)
    order = np.lexsort((starts, keys, bucket))
    keys, starts, bucket = keys[order], starts[order], bucket[order]
    cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
    rows, home = [], _home(block, n_buckets)
    for b in range(n_buckets):
        lo, hi = cuts[b], cuts[b + 1]
        if lo == hi and b != home:
            continue
        k = keys[lo:hi]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        kinds, at, many = _by_first_start(k, starts[lo:hi], first)
        packed = np.ascontiguousarray(kinds.view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()
        rows.append((block, b, width, packed, at, many, docs if b == home else b""))
    names = [c.split()[0] for c in PACK.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], t) for t in kinds], names=names)


def _candidates(length: int, n_buckets: int, width: int):
    """Packs of all windows of the base length."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        hashed = xxhash.xxh64_intdigest
        rids, sizes, hashes, n, number = [], [], [], 0, 0

        def packed():
            keys, starts, at = [], [], 0
            for h in hashes:
                k = window_keys(h, length)
                keys.append(k)
                starts.append(np.arange(at, at + len(k)))
                at += len(h)
            docs = np.array([rids, sizes], np.int64).tobytes()
            cat = np.concatenate(keys) if keys else np.empty(0, np.uint64)
            return _packs((part << 32) + number, cat, np.concatenate(starts) if starts else np.empty(0, np.int64), n_buckets, width, docs)

        for batch in batches:
            for rid, text in zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words = split_words(text)
                if len(words) < length:
                    continue
                rids.append(rid)
                sizes.append(len(words))
                hashes.append(np.fromiter(map(hashed, words), np.uint64, len(words)))
                n += len(words)
                if n >= BLOCK_WORDS:
                    yield packed()
                    rids, sizes, hashes, n, number = [], [], [], 0, number + 1
        if rids:
            yield packed()

    return made


def _repeated(group: pd.DataFrame) -> pd.DataFrame:
    """Of the packs of one bucket, the keys that occur more than once, still by block."""
    width = int(group["width"].iloc[0])
    blocks = list(group.itertuples(index=False))
    keys = [np.frombuffer(b.keys, np.uint8).reshape(-1, width) for b in blocks]
    sizes = [np.frombuffer(b.many, np.int32) if b.many else np.ones(len(k), np.int32) for b, k in zip(blocks, keys, strict=True)]
    every = np.concatenate(keys)
    lows = np.zeros((len(every), 16), np.uint8)
    lows[:, :width] = every
    parts = lows.view("<u8")
    where = np.lexsort((parts[:, 0], parts[:, 1]))
    ranked = parts[where]
    new = np.concatenate([[True], (ranked[1:] != ranked[:-1]).any(1)]) if len(every) else np.empty(0, bool)
    run = np.cumsum(new) - 1
    total = np.bincount(run, np.concatenate(sizes)[where]) if len(every) else np.empty(0)
    repeated = np.empty(len(every), bool)
    repeated[where] = total[run] > 1
    out, at = [], 0
    for b, k, size in zip(blocks, keys, sizes, strict=True):
        use = repeated[at : at + len(k)]
        at += len(k)
        if not use.any() and not b.docs:
            continue
        starts = _restored(b.starts)
        out.append((b.block, b.bucket, width, np.ascontiguousarray(k[use]).tobytes(), _pressed(starts[np.repeat(use, size)]), size[use].tobytes() if (size[use] > 1).any() else b"", b.docs))
    return pd.DataFrame(out, columns=[c.split()[0] for c in PACK.split(", ")])


def _block(group: pd.DataFrame):
    """The documents of a block (row numbers, sizes), and its surviving starts with their keys and buckets, by start."""
    docs, keys, starts = None, [], []
    for b in group.itertuples(index=False):
        if b.docs:
            docs = np.frombuffer(b.docs, np.int64).reshape(2, -1)
        packed = np.frombuffer(b.keys, np.uint8).reshape(-1, b.width)
        k = np.zeros((len(packed), 16), np.uint8)
        k[:, : b.width] = packed
        k = k.view("<u8")
        with np.errstate(over="ignore"):
            k = mixed(k[:, 0] + mixed(k[:, 1] + np.uint64(b.bucket + 1)))
        size = np.frombuffer(b.many, np.int32) if b.many else np.ones(len(k), np.int32)
        keys.append(np.repeat(k, size))
        starts.append(_restored(b.starts))
    k, s = np.concatenate(keys), np.concatenate(starts)
    order = np.argsort(s)
    return docs, k[order], s[order]


def _extended(length: int, longer: int, n_buckets: int, last: bool):
    """Packs of the windows of the longer length whose two covering windows both survived."""

    def made(group: pd.DataFrame) -> pd.DataFrame:
        docs, keys, starts = _block(group)
        if not len(starts):
            return pd.DataFrame([], columns=[c.split()[0] for c in PACK.split(", ")])
        end_of = np.cumsum(docs[1])
        at = np.searchsorted(starts, starts + (longer - length))
        has = (at < len(starts)) & (starts[np.minimum(at, len(starts) - 1)] == starts + (longer - length))
        doc = np.searchsorted(end_of, starts, side="right")
        has &= starts + longer <= end_of[np.minimum(doc, len(end_of) - 1)]
        one, two = keys[has], keys[at[has]]
        with np.errstate(over="ignore"):
            lanes = np.stack([mixed(one * np.uint64(3) + mixed(two)), mixed(two * np.uint64(5) + mixed(one))], 1)
        bucket, s = lanes[:, 1] % np.uint64(n_buckets), starts[has]
        lanes[:, 1] = lanes[:, 1] >> np.uint64(32) if last else 0  # the bytes that are kept
        order = np.lexsort((s, lanes[:, 0], lanes[:, 1], bucket))
        s, bucket, lanes = s[order], bucket[order], np.ascontiguousarray(lanes[order])
        width = 12 if last else 8
        pair = lanes.view(np.uint8).reshape(-1, 16)[:, :width]
        cuts = np.searchsorted(bucket, np.arange(n_buckets + 1, dtype=np.uint64))
        block, rows = int(group["block"].iloc[0]), []
        home = _home(block, n_buckets)
        for b in range(n_buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo == hi and b != home:
                continue
            first = np.ones(hi - lo, bool)
            first[1:] = (lanes[lo + 1 : hi] != lanes[lo : max(lo, hi - 1)]).any(1)
            kinds, at_, many = _by_first_start(pair[lo:hi], s[lo:hi], first)
            rows.append((block, b, width, np.ascontiguousarray(kinds).tobytes(), at_, many, docs.tobytes() if b == home else b""))

        return pd.DataFrame(rows, columns=[c.split()[0] for c in PACK.split(", ")])

    return made


def _covered(window: int):
    """For each document of a block with repeated windows, the word ranges that they cover."""

    def made(group: pd.DataFrame) -> pd.DataFrame:
        docs, _, starts = _block(group)
        begin = np.concatenate([[0], np.cumsum(docs[1])])
        out = []
        if len(starts):
            new = np.concatenate([[True], starts[1:] > starts[:-1] + window])
            doc = np.searchsorted(begin, starts, side="right") - 1
            new |= np.concatenate([[True], doc[1:] != doc[:-1]])
            first = np.flatnonzero(new)
            last = np.concatenate([first[1:], [len(starts)]]) - 1
            d = doc[first]
            ranges = np.stack([starts[first] - begin[d], starts[last] + window - begin[d]], 1)
            cuts = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            for lo, hi in zip(cuts, [*cuts[1:], len(d)], strict=True):
                out.append((int(docs[0][d[lo]]), ranges[lo:hi].astype(np.int64).tobytes()))
        return pd.DataFrame(out, columns=["rid", "ranges"])

    return made


def repeated_ranges(keyed: DataFrame, window: int = WINDOW, n_words: int | None = None) -> DataFrame:
    """rid, ranges (pairs of 64-bit word positions, end exclusive): what repeated windows cover. keyed: rid, text."""
    spark = keyed.sparkSession
    if n_words is None:
        n_words = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n_words = n_words // 5 + 1
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_words // BUCKET_WORDS + 1)
    # one window in 2 ** 10 at most goes on without need; the bucket tells some of the bits
    width = min(8, max(4, math.ceil((math.log2(n_words + 1) + 10 - math.log2(n_buckets)) / 8)))
    steps = levels(window)
    packs = keyed.select("rid", "text").mapInArrow(_candidates(steps[0], n_buckets, width), PACK)
    for length, longer in zip(steps, [*steps[1:], None], strict=True):
        survived = packs.repartitionById(n_buckets, F.col("bucket")).groupBy("bucket").applyInPandas(_repeated, PACK)
        by_block = survived.groupBy("block")
        if longer is None:
            return by_block.applyInPandas(_covered(window), "rid bigint, ranges binary")
        packs = by_block.applyInPandas(_extended(length, longer, n_buckets, longer == window), PACK)


def substring_dedup(docs: DataFrame, carried: list[str], window: int = WINDOW) -> DataFrame:
    """A struct ``row`` of the carried columns, n_words, n_removed and kept_text of every row."""
    row = F.struct(*[F.col(c) for c in carried])
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"), "text")
    ranges = stored(repeated_ranges(keyed, window), "substring-ranges")
    # only the texts that lose something meet their ranges in a shuffle
    marked = marked_by(keyed, "rid", hash_filter(ranges, "rid"))
    cut = marked.filter("may").join(ranges, "rid", "left").select("row", "text", "ranges")
    joined = marked.filter("not may").select("row", "text", F.lit(None).cast("binary").alias("ranges")).unionByName(cut)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, texts = [], [], []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                words = split_words(text)
                at, left = 0, []
                for a, b in np.frombuffer(spans, np.int64).reshape(-1, 2).tolist() if spans else ():
                    left += words[at:a]
                    at = b
                left += words[at:]
                totals.append(len(words))
                removed.append(len(words) - len(left))
                texts.append(b" ".join(left).decode())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], names=["row", "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(kept, f"row {keyed.schema['row'].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_text string")


def substring_report(docs: DataFrame) -> DataFrame:
    out = substring_dedup(docs.select("doc_id", "text"), ["doc_id"])
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))

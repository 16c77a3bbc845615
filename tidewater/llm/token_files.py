"""Token-ID output in files of Re-Pair compressed shards.

Documents are dealt to ranges of ascending identifiers, encoded in that order, and cut into shards of
about SHARD_IDS ids. In each shard the frequent pairs of neighbouring ids (LEAST_COUNT of them or more)
are replaced by nonterminals, round after round until no frequent pair is left; a pair never reaches over
a document's end. A round replaces all pairs that are frequent then, of overlapping ones the first. A shard
stores its rules, the expansion length of every nonterminal and where each document begins in the compressed
sequence, which is pressed in frames of FRAME symbols, so a document or a part of one is decoded from its
own frames. A shard is one row of a Parquet table, so the files can lie in any store and are written by
Spark's commit protocol.

File format, one row a shard: part, seq (order of shards), doc_ids (int64), sizes (ids of each document
with its end id, int64), rules (pairs of uint32; nonterminal FIRST_RULE + i), lengths (uint32 expansion
lengths of the rules), begins (int64 places in the sequence), frames (int64 byte offsets of the frames in
the sequence), sequence (uint32, each frame pressed by zstd).

Defined results: a null text counts as empty and has the end id alone; rows of equal identifiers follow
in the order of their texts; null identifiers come first; an empty table writes no shard.
"""

from __future__ import annotations

import functools
import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import new_path

TOKENIZER = "word_bpe_49k.json"
END = 1
SHARD_IDS = 1_000_000
FIRST_RULE = 1 << 16
#: A pair that occurs so often in a shard is frequent; a rule takes the room of three ids.
LEAST_COUNT = 4
#: Symbols of the compressed sequence that are pressed together.
FRAME = 1 << 16
#: Words whose ids a Python worker keeps, and bytes of text that it encodes at once.
KEPT_WORDS, GROUP_BYTES = 400_000, 8 << 20
#: The signs that byte-level tokenizers write for bytes: printable ones stand for themselves, the others follow from 256 on.
_OTHER = np.array([b not in (*range(33, 127), *range(161, 173), *range(174, 256)) for b in range(256)])
_SIGNS = np.where(_OTHER, 255 + np.cumsum(_OTHER), np.arange(256)).astype("<u4")

SHARD = "part int, seq int, n_ids bigint, doc_ids binary, nulls binary, sizes binary, rules binary, lengths binary, begins binary, frames binary, sequence binary"

#: Texts of these code points only are cut into words here: lower-casing and composing them leaves no choice.
_PLAIN = re.compile(r"[\t-\r -~\xa1-\xffŒœ‐-―‘-‟…€]*")
_L, _N = r"a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xffŒœ", r"0-9\xb2\xb3\xb9\xbc-\xbe"
#: Words, and the line feeds that part chunks.
_PARTS = re.compile(rf"[{_L}]+|'(?:[stmd]|re|ve|ll)|[{_N}]|[^\t-\r {_L}{_N}]+|\n")
_SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... sizes[i] numbers long, for every i in a row."""
    places = np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    places += np.arange(len(places))
    return places


def bounds(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def taken(values: np.ndarray, cuts: np.ndarray, places: np.ndarray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values, of which cuts has the bounds, one after the other as places name them; and their bounds."""
    runs = pa.LargeListArray.from_arrays(pa.array(cuts, pa.int64()), pa.array(values)).take(pa.array(places))
    return runs.flatten().to_numpy(), runs.offsets.to_numpy()


class Vocabulary:
    """Ids of words, each word encoded when it is first met.

    No word reaches over white space, so the ids of a plain text are those of its chunks (what white space
    parts) in a row, and a chunk's ids those of its words. A group's distinct chunks are cut into words once,
    all in one string of lines; a line feed is word 0, which has no ids.
    """

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        # the same merges for words that are cut and in lower case already
        self.pieces = self.full.model.tokenize
        self.begin()

    def begin(self) -> None:
        self.places: defaultdict[str, int] = defaultdict(None, {"\n": 0})
        self.places.default_factory = self.places.__len__  # a new word gets the next number
        self.ids, self.starts = array("I"), array("q", [0, 0])

    def forget(self) -> None:
        """Drop the words met last: those met first are mostly the frequent ones. If these take much room, drop all."""
        keep = min(len(self.places), KEPT_WORDS // 2)
        if self.starts[keep] > 4 * KEPT_WORDS:
            return self.begin()
        while len(self.places) > keep:
            self.places.popitem()
        del self.ids[self.starts[keep] :], self.starts[keep + 1 :]

    def _learn(self) -> None:
        """Encode the words that have a number but no ids yet."""
        new = list(islice(reversed(self.places), len(self.places) - len(self.starts) + 1))[::-1]
        for at in range(0, len(new), 4096):
            coded = np.frombuffer("\n".join(new[at : at + 4096]).encode(), np.uint8)
            told = list(map(self.pieces, _SIGNS[coded].tobytes().decode("utf-32-le").split(chr(_SIGNS[10]))))
            ends = np.cumsum(np.fromiter(map(len, told), np.int64, len(told)))
            self.starts.frombytes((len(self.ids) + ends).tobytes())
            self.ids.extend([piece.id for word in told for piece in word])

    def _chunks(self, lines: str) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks, a line each, in a row, and the bounds of each."""
        if len(self.places) > KEPT_WORDS or len(self.ids) > 8 * KEPT_WORDS:
            self.forget()
        cut = _PARTS.findall(lines)
        at = np.fromiter(map(self.places.__getitem__, cut), np.int64, len(cut))
        if len(self.places) >= len(self.starts):
            self._learn()
        ids, cuts = taken(np.frombuffer(self.ids, np.uint32), np.frombuffer(self.starts, np.int64), at)
        return ids, np.concatenate([[0], cuts[np.flatnonzero(at == 0)], [len(ids)]])

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        told = texts.to_pylist()
        plain = [not _SPECIAL.search(t) and bool(_PLAIN.fullmatch(t)) for t in told]
        chunks = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(plain, pa.bool_()), texts, "")))
        distinct = chunks.flatten().dictionary_encode()
        ids, at = self._chunks(pc.binary_join(pa.ListArray.from_arrays([0, len(distinct.dictionary)], distinct.dictionary), "\n")[0].as_py())
        flat, cuts = taken(ids, at, distinct.indices)
        offsets = chunks.offsets.to_numpy()
        cuts = cuts[offsets - offsets[0]].tolist()
        return [flat[a:b] if p else np.array(self.full.encode(t, add_special_tokens=False).ids, np.uint32) for t, p, a, b in zip(told, plain, cuts[:-1], cuts[1:], strict=True)]


vocabulary = functools.cache(Vocabulary)


def encode_texts(texts: pa.Array, path: str) -> list[np.ndarray]:
    """The tokenizer's ids of each text (strings without nulls) as 32-bit numbers."""
    return vocabulary(path).encode(texts)


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that end as soon as their sizes come to so much."""
    begin, size = 0, 0
    for i, n in enumerate(sizes, 1):
        size += n
        if size >= most or i == len(sizes):
            yield begin, i
            begin, size = i, 0


def by_pair(one: np.ndarray, two: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places in the order of their pairs, and where each pair begins among them."""
    a, b = one[at].astype(np.uint64), two[at].astype(np.uint64)
    place, wide = len(one).bit_length(), int(max(one.max(), two.max())).bit_length()
    if place + 2 * wide <= 64:  # pair and place fit into one number; numbers alone sort several times faster than places by their keys
        a <<= np.uint64(wide + place)
        b <<= np.uint64(place)
        a |= b
        a |= at.view(np.uint64)
        a.sort()
        at, pairs = (a & np.uint64((1 << place) - 1)).view(np.int64), a >> np.uint64(place)
    else:
        pairs = a << np.uint64(32) | b
        order = np.argsort(pairs)
        at, pairs = at[order], pairs[order]
    return at, np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))


def repair(ids: np.ndarray, least: int = LEAST_COUNT) -> tuple[np.ndarray, np.ndarray]:
    """The compressed sequence and the rules (pairs), in the order they were made; no pair is left ``least`` times.

    A round leaves no place of a frequent pair: it is replaced, or its first symbol was the second of a pair
    that is. Pairs without a symbol of the last round were counted in it or earlier, and are not more by now,
    so later rounds count only pairs with such a symbol.
    """
    seq, rules = ids.astype(np.uint32), [np.empty((0, 2), np.uint32)]
    symbol = np.empty(len(seq), np.uint32)
    made = fresh = 0
    while len(seq) > 1:
        one, two = seq[:-1], seq[1:]
        new = seq >= fresh
        at = np.flatnonzero(new[:-1] | new[1:]) if fresh else np.arange(len(one))
        at = at[(one[at] != END) & (two[at] != END)]
        if not len(at):
            break
        at, begin = by_pair(one, two, at)
        count = np.diff(begin, append=len(at))
        begin, count = begin[count >= least], count[count >= least]
        if not len(begin):
            break
        rules.append(np.stack([one[at[begin]], two[at[begin]]], 1))
        fresh = FIRST_RULE + made
        made += len(begin)
        at = at[ranges(begin, count)]
        symbol[at] = np.repeat(np.arange(fresh, fresh + len(begin), dtype=np.uint32), count)
        at = np.sort(at)
        # of pairs that overlap in a row, every second one from the first on
        new = np.concatenate([[True], at[1:] != at[:-1] + 1])
        at = at[((np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]) & 1) == 0]
        seq[at] = symbol[at]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        seq = seq[stay]
    return seq, np.concatenate(rules)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each nonterminal stands for; as many passes as rules are nested."""
    deep, of = rules >= FIRST_RULE, np.maximum(rules, FIRST_RULE) - FIRST_RULE
    lengths = np.full(len(rules), 2, np.int64)
    while len(rules) and not np.array_equal(told := np.where(deep, lengths[of], 1).sum(1), lengths):
        lengths = told
    return lengths.astype(np.uint32)


def expanded(seq: np.ndarray, rules: np.ndarray) -> np.ndarray:
    """The ids that a part of a sequence stands for."""
    while len(seq) and (deep := seq >= FIRST_RULE).any():
        out = np.repeat(seq, 1 + deep)
        at = np.flatnonzero(deep) + np.arange(deep.sum())
        pairs = rules[seq[deep] - FIRST_RULE]
        out[at], out[at + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def unrolled(seq: np.ndarray, whole: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The ids that a part of a sequence stands for, from all rules' expansions in a row and the bounds of each."""
    deep = seq >= FIRST_RULE
    of = seq[deep] - FIRST_RULE
    sizes = np.ones(len(seq), np.int64)
    sizes[deep] = places[of + 1] - places[of]
    out = np.repeat(seq, sizes)
    out[np.repeat(deep, sizes)] = whole[ranges(places[of], sizes[deep])]
    return out


def pressed(seq: np.ndarray) -> tuple[bytes, bytes]:
    """A sequence in frames: the byte offsets of the frames (one more than there are), and the frames."""
    press = zstandard.ZstdCompressor(level=1)
    frames = [press.compress(seq[at : at + FRAME].tobytes()) for at in range(0, len(seq), FRAME)]
    return bounds(np.array([len(f) for f in frames], np.int64)).astype(np.int64).tobytes(), b"".join(frames)


def symbols(shard: dict, begin: int, end: int) -> np.ndarray:
    """A part of a shard's sequence; only the frames that hold it are unpressed."""
    if begin >= end:
        return np.empty(0, np.uint32)
    press, frames = zstandard.ZstdDecompressor(), np.frombuffer(shard["frames"], np.int64)
    first, last = begin // FRAME, (end - 1) // FRAME
    told = [np.frombuffer(press.decompress(shard["sequence"][frames[i] : frames[i + 1]]), np.uint32) for i in range(first, last + 1)]
    return np.concatenate(told)[begin - first * FRAME : end - first * FRAME]


def expansion_lengths(seq: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids that each symbol stands for."""
    each, deep = np.ones(len(seq), np.int64), seq >= FIRST_RULE
    each[deep] = lengths[seq[deep] - FIRST_RULE]
    return each


def _shard(part: int, seq: int, docs: list, ids: list[np.ndarray]) -> tuple:
    sizes = np.array([len(x) + 1 for x in ids], np.int64)
    last = np.cumsum(sizes) - 1
    flat = np.full(int(sizes.sum()), END, np.uint32)
    within = np.ones(len(flat), bool)
    within[last] = False
    flat[within] = np.concatenate(ids)
    short, rules = repair(flat)
    lengths = rule_lengths(rules)
    ends = np.flatnonzero(short == END)
    if len(ends) != len(ids):  # an id within a text equals the end id: find the ends by expansion lengths
        ends = np.searchsorted(np.cumsum(expansion_lengths(short, lengths)), last + 1)
    begins = np.concatenate([[0], ends + 1]).astype(np.int64)
    nulls = bytes(d is None for d in docs)
    return (part, seq, int(sizes.sum()), np.array([d or 0 for d in docs], np.int64).tobytes(), nulls, sizes.tobytes(), rules.tobytes(), lengths.tobytes(), begins.tobytes(), *pressed(short))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*[c.split() for c in SHARD.split(", ")], strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=list(names))


def write_tokens(docs: DataFrame, out: str, path: str | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Encode all documents and write their shards to ``out``, in ascending order of doc_id."""
    path = path or public_tokenizers.path(TOKENIZER)
    spark = docs.sparkSession
    n = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            keys, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for lo, hi in groups(pc.binary_length(texts).to_pylist(), GROUP_BYTES):
                for key, x in zip(keys[lo:hi], encode_texts(texts.slice(lo, hi - lo), path), strict=True):
                    held.append(key)
                    ids.append(x)
                    size += len(x) + 1
                    if size >= shard_ids:
                        yield _batch([_shard(part, seq, held, ids)])
                        seq, held, ids, size = seq + 1, [], [], 0
        if held:
            yield _batch([_shard(part, seq, held, ids)])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(shards, SHARD).write.parquet(out)


def read_tokens(spark: SparkSession, out: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, ids (32-bit little-endian) of every document in the files."""
    shards = spark.read.schema(SHARD).parquet(out)
    sums = shards.select("part", "seq", "n_ids")
    parts = sums.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    places = sums.join(before, "part").select("part", "seq", (F.col("part_start") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")).alias("shard_start"))

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                rules = np.frombuffer(s["rules"], np.uint32).reshape(-1, 2)
                whole, places = expanded(np.arange(FIRST_RULE, FIRST_RULE + len(rules), dtype=np.uint32), rules), bounds(np.frombuffer(s["lengths"], np.uint32).astype(np.int64))
                begins, sizes = np.frombuffer(s["begins"], np.int64), np.frombuffer(s["sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                n, seq = len(sizes), symbols(s, 0, int(begins[-1]))
                keys = [None if null else k for k, null in zip(np.frombuffer(s["doc_ids"], np.int64).tolist(), s["nulls"], strict=True)]
                for lo in range(0, n, 1024):
                    hi = min(n, lo + 1024)
                    flat = unrolled(seq[begins[lo] : begins[hi]], whole, places).astype("<u4").tobytes()
                    first = starts[lo]
                    ids = [flat[4 * (a - first) : 4 * (a - first + k)] for a, k in zip(starts[lo:hi].tolist(), sizes[lo:hi].tolist(), strict=True)]
                    m = hi - lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([s["part"]] * m, pa.int32()), pa.array([s["seq"]] * m, pa.int32()), pa.array(keys[lo:hi], pa.int64()), pa.array(starts[lo:hi]), pa.array(sizes[lo:hi]), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids if with_ids else [None] * m, pa.binary())],
                        names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
                    )

    rows = shards.mapInArrow(documents, "part int, seq int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    return rows.join(places, ["part", "seq"]).select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")


def read_document(shard: dict, at: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of one document of a shard's row, or those from ``first`` up to ``last`` of them.

    Only the document's own frames are unpressed; the expansion lengths tell which of its symbols hold the
    part, and only those are expanded.
    """
    begins, size = np.frombuffer(shard["begins"], np.int64), int(np.frombuffer(shard["sizes"], np.int64)[at])
    first, last = min(first, size), size if last is None else min(last, size)
    if first >= last:
        return np.empty(0, np.uint32)
    seq, rules = symbols(shard, int(begins[at]), int(begins[at + 1])), np.frombuffer(shard["rules"], np.uint32).reshape(-1, 2)
    ends = np.cumsum(expansion_lengths(seq, np.frombuffer(shard["lengths"], np.uint32)))
    lo, hi = np.searchsorted(ends, first, side="right"), np.searchsorted(ends, last, side="left") + 1
    before = int(ends[lo - 1]) if lo else 0
    return expanded(seq[lo:hi], rules)[first - before : last - before]


def token_file_rows(docs: DataFrame, path: str | None = None) -> DataFrame:
    spark = docs.sparkSession
    out = new_path(spark, "token-files")
    write_tokens(docs.select("doc_id", "text"), out, path)
    return read_tokens(spark, out, with_ids=False).drop("ids")

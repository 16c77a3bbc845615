"""Byte-level BPE encoding and decoding with a vocabulary of ranks.

Texts are cut into pre-tokens by the vocabulary's pattern. All distinct pre-tokens of the corpus meet
in one shuffle (each task sends each of its words once, with its count). The most frequent words, at
most HOT_WORDS of them, are encoded there and broadcast with their ids; the occurrences of all other
words are exploded with their positions, meet by word, where each is encoded once, and their ids are
joined back and put in place by position. Decoding
looks each id up in the token-byte table, which has the vocabulary's bounded size.

Defined results: a null text counts as empty and has no ids; repeated rows each get their result; the
strings of special tokens are ordinary text; lone surrogates cannot occur in a Spark string.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored

RANKS = "byte_bpe_50k.tiktoken"
#: Words of the broadcast dictionary at most, and the least count of such a word.
HOT_WORDS, HOT_COUNT = 300_000, 8
#: Words that a task keeps before it sends their counts on.
KEPT_WORDS = 400_000
#: Pre-tokens of the documents that are shuffled as one row.
GROUP_WORDS = 32_768
HOLE = 0xFFFFFFFF

_EXACT = regex.compile(public_tokenizers.PATTERN)
#: The same pattern with its classes written out for texts of code points up to U+00FF.
_L, _N, _S = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", r"0-9\xb2\xb3\xb9\xbc-\xbe", r"\t-\r \x85\xa0"
_NARROW = re.compile(rf" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = re.compile(r"[^\x00-\xff]")


def pre_tokens(text: str) -> list[str]:
    return (_EXACT if _WIDE.search(text) else _NARROW).findall(text)


@functools.cache
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: the bytes of each id."""
    with open(path, "rb") as f:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, f)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


@functools.cache
def encoder(path: str) -> tiktoken.Encoding:
    ranks = {token: i for i, token in enumerate(token_bytes(path)) if token}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _packed(press: zstandard.ZstdCompressor, words: list[str], *columns: np.ndarray) -> bytes:
    """Words with a column or more of numbers, in one pressed block."""
    raw = [w.encode() for w in words]
    planes = [np.fromiter(map(len, raw), "<u4", len(raw)), *columns]
    return press.compress(len(raw).to_bytes(4, "little") + b"".join([_planes(c) for c in planes]) + b"".join(raw))


def _unpacked(block: bytes, *kinds: str) -> tuple[list[str], list[np.ndarray]]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, at, columns = int.from_bytes(raw[:4], "little"), 4, []
    for kind in ("<u4", *kinds):
        size = np.dtype(kind).itemsize * n
        columns.append(_unplaned(raw[at : at + size], kind))
        at += size
    ends = (at + np.cumsum(columns[0], dtype=np.int64)).tolist()
    return [raw[i:j].decode() for i, j in zip([at, *ends], ends, strict=False)], columns[1:]


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of equal weight together."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _by_bucket(buckets: int, words: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    """One packed block for each bucket of words. A word's bucket is its hash's, whichever task sends it."""
    press = zstandard.ZstdCompressor(level=3)
    of = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.int32, len(words))
    order = np.argsort(of, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(of[order])) + 1).tolist(), len(order)]
    names, blocks = [], []
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i < j:
            some = order[i:j]
            names.append(int(of[some[0]]))
            blocks.append(_packed(press, [words[k] for k in some.tolist()], *[c[some] for c in columns]))
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(blocks, pa.binary())], names=["bucket", "block"])


def _buckets(texts: DataFrame) -> int:
    return max(2, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dictionary(texts: DataFrame, path: str, least: int) -> DataFrame:
    """word, n, ids (32-bit little-endian): every pre-token that occurs ``least`` times, each encoded once.

    A task holds the distinct words of its share of the word hashes, so more partitions need less memory.
    """
    buckets = _buckets(texts)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def sent() -> pa.RecordBatch:
            words = sorted(seen)
            return _by_bucket(buckets, words, np.fromiter(map(seen.__getitem__, words), "<u8", len(words)))

        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(pre_tokens(text))
                if len(seen) > KEPT_WORDS:
                    yield sent()
                    seen.clear()
        if seen:
            yield sent()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}
        for batch in batches:
            for block in batch.column("block").to_pylist():
                words, (counts,) = _unpacked(block, "<u8")
                for w, n in zip(words, counts.tolist(), strict=True):
                    total[w] = total.get(w, 0) + n
        encode, often = encoder(path).encode_ordinary, [w for w, n in total.items() if n >= least]
        for at in range(0, len(often), 10_000):
            some = often[at : at + 10_000]
            packed = pa.array([np.array(encode(w), "<u4").tobytes() for w in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.string()), pa.array([total[w] for w in some], pa.int64()), packed], names=["word", "n", "ids"])

    blocks = texts.mapInArrow(counted, "bucket int, block binary").repartition(buckets, "bucket")
    return stored(blocks.mapInArrow(encoded, "word string, n bigint, ids binary"), "bpe-words")


def hot_words(words: DataFrame, limit: int) -> tuple[dict[str, int], list[bytes]]:
    """The most frequent words by number, and their ids; limit bounds both."""
    found = words
    if found.count() > limit:  # counts above the smallest one that leaves no more than limit words
        cut = found.groupBy("n").agg(F.count(F.lit(1)).alias("w")).orderBy(F.col("n").desc())
        total, floor = 0, None
        for row in cut.collect() if cut.count() <= limit else cut.limit(limit).collect():
            total += row["w"]
            if total > limit:
                break
            floor = row["n"]
        found = words.filter(F.col("n") >= floor) if floor is not None else words.limit(0)
    table = found.orderBy(F.col("n").desc(), "word").select("word", "ids").toArrow()  # small numbers for frequent words
    return {w: i for i, w in enumerate(table.column("word").to_pylist())}, table.column("ids").to_pylist()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.Array], list[list[str]]]]:
    """Documents in groups of GROUP_WORDS pre-tokens or one document: the first's number, rows, pre-tokens of each.

    Groups follow from the order of the documents alone, not from the batches they come in.
    """
    name, rows, cut, size = None, [], [], 0
    for batch in batches:
        own, first = batch.column("row"), 0
        for i, (rid, text) in enumerate(zip(batch.column("rid").to_pylist(), batch.column("text").to_pylist(), strict=True)):
            name = rid if name is None else name
            cut.append(pre_tokens(text))
            size += len(cut[-1])
            if size >= GROUP_WORDS:
                yield name, [*rows, own.slice(first, i + 1 - first)], cut
                name, rows, cut, size, first = None, [], [], 0, i + 1
        if first < len(own):
            rows.append(own.slice(first))
    if cut:
        yield name, rows, cut


def encoded_rows(docs: DataFrame, carried: list[str], path: str, hot_limit: int = HOT_WORDS, hot_least: int = HOT_COUNT, finish=None, out: str = "ids binary") -> DataFrame:
    """A struct ``row`` of the carried columns, and what ``finish`` makes of the ids (columns ``out``).

    Rows are numbered in the order of the scan, so docs should be a table as read or stored. Shuffled are
    packed blocks: of words by hash, of rare words' places by hash and back by group of documents.
    """
    spark = docs.sparkSession
    row = F.struct(*[F.col(c) for c in carried])
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), row.alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    buckets = _buckets(docs)
    words = dictionary(keyed.select("text"), path, hot_least)
    release(spark)
    numbers, hot_ids = hot_words(words, hot_limit)
    shared, shared_ids = spark.sparkContext.broadcast(numbers), spark.sparkContext.broadcast(hot_ids)

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, found, names, ats = shared.value, [], [], []

        def sent() -> pa.RecordBatch:
            return _by_bucket(buckets, found, np.array(names, "<i8"), np.array(ats, "<u4"))

        for name, _, cut in _groups(batches):
            at = 0
            for tokens in cut:
                for i, w in enumerate(tokens, at):
                    if w not in hot:
                        found.append(w)
                        ats.append(i)
                at += len(tokens)
            names.extend([name] * (len(found) - len(names)))
            if len(found) > KEPT_WORDS:
                yield sent()
                found, names, ats = [], [], []
        if found:
            yield sent()

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = encoder(path).encode_ordinary, {}
        names, ats, ids = [], [], []

        def sent() -> pa.RecordBatch:
            name, at = np.concatenate(names), np.concatenate(ats)
            order = np.argsort(name, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(name[order])) + 1).tolist(), len(order)]
            each, puts = [], []
            for i, j in zip(cuts, cuts[1:], strict=False):
                some = order[i:j]
                own = [ids[k] for k in some.tolist()]
                each.append(int(name[some[0]]))
                puts.append(len(own).to_bytes(4, "little") + _planes(at[some]) + _planes(np.fromiter(map(len, own), "<u4", len(own))) + b"".join(own))
            return pa.RecordBatch.from_arrays([pa.array(each, pa.int64()), pa.array(puts, pa.binary())], names=["rid", "put"])

        for batch in batches:
            for block in batch.column("block").to_pylist():
                some, (name, at) = _unpacked(block, "<i8", "<u4")
                if len(known) > KEPT_WORDS:
                    known.clear()
                for w in some:
                    if w not in known:
                        known[w] = np.array(encode(w), "<u4").tobytes()
                    ids.append(known[w])
                names.append(name)
                ats.append(at)
                if len(ids) > KEPT_WORDS:
                    yield sent()
                    names, ats, ids = [], [], []
        if ids:
            yield sent()

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, get = zstandard.ZstdCompressor(level=3), shared.value.get
        for name, rows, cut in _groups(batches):
            flat = pa.concat_arrays(rows)
            code = np.array([get(w, HOLE) for tokens in cut for w in tokens], "<u4")
            sizes = np.fromiter(map(len, cut), "<u4", len(cut))
            own = pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), own, pa.array([sizes.tobytes()]), pa.array([press.compress(_planes(code))])], names=["rid", "rows", "sizes", "codes"])

    kind = keyed.schema["row"].dataType.simpleString()
    blocks = keyed.mapInArrow(rare, "bucket int, block binary").repartition(buckets, "bucket")
    put = blocks.mapInArrow(placed, "rid bigint, put binary").groupBy("rid").agg(F.collect_list("put").alias("puts"))
    joined = keyed.mapInArrow(coded, f"rid bigint, rows array<{kind}>, sizes binary, codes binary").join(put, "rid", "left").select("rows", "sizes", "codes", "puts")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, hot = zstandard.ZstdDecompressor(), shared_ids.value
        names = ["row", *[c.split()[0] for c in out.split(", ")]]
        for batch in batches:
            rows = batch.column("rows")
            for i, (sizes, codes, puts) in enumerate(zip(batch.column("sizes").to_pylist(), batch.column("codes").to_pylist(), batch.column("puts").to_pylist(), strict=True)):
                parts = [hot[c] if c != HOLE else b"" for c in _unplaned(press.decompress(codes), "<u4").tolist()]
                for p in puts or ():
                    n = int.from_bytes(p[:4], "little")
                    ends = (4 + 8 * n + np.cumsum(_unplaned(p[4 + 4 * n : 4 + 8 * n], "<u4"), dtype=np.int64)).tolist()
                    for at, a, b in zip(_unplaned(p[4 : 4 + 4 * n], "<u4").tolist(), [4 + 8 * n, *ends], ends, strict=False):
                        parts[at] = p[a:b]
                ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64).tolist()
                results = [b"".join(parts[a:b]) for a, b in zip([0, *ends], ends, strict=False)]
                columns = finish(results) if finish else [pa.array(results, pa.binary())]
                yield pa.RecordBatch.from_arrays([rows.slice(i, 1).flatten(), *columns], names=names)

    return joined.mapInArrow(whole, f"row {kind}, {out}")


def decoded(ids: bytes, table: list[bytes]) -> bytes:
    return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()])


def bpe_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    path = path or public_tokenizers.path(RANKS)

    def digests(results: list[bytes]) -> list[pa.Array]:
        table = token_bytes(path)
        return [
            pa.array([len(x) // 4 for x in results], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in results]),
            pa.array([hashlib.sha256(decoded(x, table)).hexdigest() for x in results]),
        ]

    rows = encoded_rows(docs.select("doc_id", "text"), ["doc_id"], path, finish=digests, out="n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return rows.select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and token_ids array<int> of every document."""
    path = path or public_tokenizers.path(RANKS)

    def arrays(results: list[bytes]) -> list[pa.Array]:
        return [pa.array([np.frombuffer(x, "<i4") for x in results], pa.list_(pa.int32()))]

    return encoded_rows(docs.select("doc_id", "text"), ["doc_id"], path, finish=arrays, out="token_ids array<int>").select("row.doc_id", "token_ids")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and token_ids."""
    path = path or public_tokenizers.path(RANKS)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(path)
        for batch in batches:
            out = [b"".join([table[i] for i in ids or ()]).decode("utf-8", "replace") for ids in batch.column("token_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(texts, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")

"""Toxicity: subword-bag embeddings, averaged into a linear softmax, trained jointly in numpy.

Words are runs of letters and digits of the lower-cased text. A word is the bag of its byte n-grams
(GRAMS, with a blank on either side) and of itself, hashed to BUCKETS vectors; a window of WINDOW words
is the mean of its words' means; a softmax over two classes reads it. A text scores as its most toxic
window, so a long text does not dilute a short insult, and a misspelt word shares most n-grams with the
word it stands for. All windows of a text are scored.

Fitted on a sample of labelled rows, chosen by a hash of the identifier: about MAX_FIT_ROWS of them and about
MAX_FIT_BYTES of text at most, whole texts and all windows of each. Texts are kept as word numbers, from
which a mini-batch is built when its turn comes. Each half of the texts teaches a first model that looks
through the other half; windows of toxic texts that it finds clean are left out of the final fit.

Defined results: a null text counts as empty; a text without words has the score of no evidence, the
calibrated bias; without labelled rows of both classes every score is 0; repeated rows each get theirs.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_fold

#: Labelled rows, and bytes of their texts, that the model is fitted on, about.
MAX_FIT_ROWS, MAX_FIT_BYTES = 6_000, 24 << 20
GRAMS = (3, 4, 5)
BUCKETS = 1 << 18
DIM, EPOCHS = 4, 6
WINDOW, STRIDE = 12, 6
#: Bytes that numpy looks at together.
SLICE = 1 << 20

#: ASCII that is neither letter nor digit becomes a blank.
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_POWERS = (np.uint64(0x9E3779B97F4A7C15) ** np.arange(64, dtype=np.uint64)).astype(np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(32))) & np.uint64(BUCKETS - 1)).astype(np.int64)


def plain(text: str) -> bytes:
    """The lower-cased text with blanks between its words."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_BLANK)


def words_and_grams(text: str) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    return grams(plain(text))


def grams(raw: bytes) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The words' starts among the bytes, and for each kind of subword (word number, bucket) of its occurrences."""
    b = np.frombuffer(b" " + raw + b" ", np.uint8).astype(np.uint64)
    blank = b == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before a word
    if not len(starts):
        return starts, []
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1  # the blank behind it
    number = np.cumsum(np.concatenate([[0], (blank[:-1] & ~blank[1:]).astype(np.int64)]))  # of the word begun before a byte
    number = np.concatenate([number[1:], number[-1:]]) - 1
    inner = np.concatenate([[0], np.cumsum(blank)])
    found = []
    for k in GRAMS:
        if len(b) < k:
            continue
        at = np.flatnonzero((inner[k - 1 : -1] - inner[1 : len(b) - k + 2]) == 0)  # no blank inside
        at = at[~(blank[at] & blank[at + k - 1] & (k < 2))]
        h = np.full(len(at), k, np.uint64)
        for j in range(k):
            h = h * np.uint64(0x100000001B3) + b[at + j]
        found.append((number[at], _mixed(h)))
    within = np.arange(len(b)) - starts[np.clip(number, 0, None)]
    whole = np.add.reduceat(b * _POWERS[within.clip(0, 63)] * ((within > 0) & ~blank), starts)
    found.append((np.arange(len(starts)), _mixed(whole + np.uint64(1))))
    return starts, found


def slices(text: str) -> Iterator[str]:
    """The text in pieces that end at blanks, none lost."""
    at = 0
    while len(text) - at > SLICE:
        cut = text.rfind(" ", at, at + SLICE)
        cut = cut if cut > at else at + SLICE
        yield text[at:cut]
        at = cut
    yield text[at:]


def word_means(text: str, table: np.ndarray) -> np.ndarray:
    """For each word the mean of its subwords' entries in a table of numbers."""
    starts, found = words_and_grams(text)
    n = len(starts)
    total, count = np.zeros(n), np.zeros(n)
    for word, bucket in found:
        total += np.bincount(word, table[bucket], n)
        count += np.bincount(word, minlength=n)
    return total / np.maximum(count, 1)


def window_starts(n: int) -> np.ndarray:
    return np.arange(0, max(1, n - WINDOW + STRIDE), STRIDE)


def toxic_logit(text: str, table: np.ndarray, bias: float) -> float:
    """The largest logit of a window; the bias where there is no word."""
    means = [word_means(piece, table) for piece in slices(text)]
    values = np.concatenate(means)
    if not len(values):
        return bias
    at = window_starts(len(values))
    sums = np.concatenate([[0], np.cumsum(values)])
    end = np.minimum(at + WINDOW, len(values))
    return float(((sums[end] - sums[at]) / (end - at)).max() + bias)


class Sample:
    """Texts as word numbers, each word's buckets, and all windows: document, begin among the word numbers, size."""

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = {}
        words, docs, begins, buckets, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        total = 0
        for d, text in enumerate(texts):
            said = [w for piece in slices(text) for w in plain(piece).split()]
            if not said:
                continue
            new = [w for w in dict.fromkeys(said) if w not in number]
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            ids = np.fromiter(map(number.__getitem__, said), np.int32, len(said))
            starts, found = grams(b" ".join(new))
            if found:
                word = np.concatenate([w for w, _ in found])
                order = np.argsort(word, kind="stable")
                buckets.append(np.concatenate([x for _, x in found])[order].astype(np.int32))
                counts.append(np.bincount(word, minlength=len(starts)))
            at = window_starts(len(ids))
            words.append(ids)
            docs.append(np.full(len(at), d))
            begins.append(total + at)
            total += len(ids)
        self.words, self.doc, self.begin = np.concatenate(words), np.concatenate(docs), np.concatenate(begins)
        self.buckets, self.per = np.concatenate(buckets), np.concatenate(counts)
        self.first = np.cumsum(self.per) - self.per
        ends = np.cumsum(np.bincount(self.doc, np.diff(self.begin, append=total), len(texts))).astype(np.int64)
        self.size = np.minimum(WINDOW, ends[self.doc] - self.begin)

    def logits(self, table: np.ndarray, bias: float) -> np.ndarray:
        """The logit of each window."""
        means = np.add.reduceat(table[self.buckets], self.first) / self.per
        sums = np.concatenate([[0], np.cumsum(means[self.words])])
        return (sums[self.begin + self.size] - sums[self.begin]) / self.size + bias


def _runs(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of runs, one behind the other, and where each run begins among them."""
    begin = np.cumsum(size) - size
    return np.repeat(first - begin, size) + np.arange(size.sum()), begin


class Distinct:
    """The different ones among numbers below a bound, in order, and which of them each number is."""

    def __init__(self, bound: int):
        self.met, self.slot = np.zeros(bound, bool), np.empty(bound, np.int64)

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.met[numbers] = True
        found = np.flatnonzero(self.met)
        self.met[found] = False
        self.slot[found] = np.arange(len(found))
        return found, self.slot[numbers]


def _fit_windows(y, sample: Sample, chosen: np.ndarray, rng, epochs: int, rate: float = 0.5, batch: int = 512):
    """Embeddings E and softmax weights W, b, by mini-batches of Adagrad over the chosen windows; classes count alike."""
    E = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    W, b = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    W[:, 1], W[:, 0] = 0.5, -0.5
    gE, gW, gb = np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
    words, cells = Distinct(len(sample.per)), Distinct(BUCKETS)
    n = len(chosen)
    y = y[chosen]
    share = np.array([0.5 / max(1, (y == 0).sum()), 0.5 / max(1, (y == 1).sum())]) * n
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at : at + batch]
            size = sample.size[chosen[pick]]
            place, begin = _runs(sample.begin[chosen[pick]], size)
            # a batch's different words are looked up once
            word, which = words(sample.words[place])
            per = sample.per[word]
            entry, first = _runs(sample.first[word], per)
            col = sample.buckets[entry]
            means = np.add.reduceat(E[col], first) / per[:, None].astype(np.float32)
            X = np.add.reduceat(means[which], begin) / size[:, None].astype(np.float32)
            z = X @ W + b
            z -= z.max(1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(pick)), y[pick]] -= 1
            p *= share[y[pick]][:, None] / len(pick)
            dX, dW, db = p @ W.T / size[:, None], X.T @ p, p.sum(0)
            dword = [np.bincount(which, np.repeat(dX[:, k], size), len(word)) / per for k in range(DIM)]
            used, where = cells(col)
            dE = np.stack([np.bincount(where, np.repeat(dword[k], per), len(used)) for k in range(DIM)], 1)
            gE[used] += (dE**2).mean(1)
            gW += dW**2
            gb += db**2
            E[used] -= rate * dE / np.sqrt(gE[used])[:, None]
            W -= 0.1 * dW / np.sqrt(gW)
            b -= 0.1 * db / np.sqrt(gb)
    return (E @ (W[:, 1] - W[:, 0])).astype(np.float64), float(b[1] - b[0])


def train(texts: list[str], labels: list[int], seed: int = 1, epochs: int = EPOCHS) -> dict:
    """The model as one number a bucket, a bias, and the calibration of a text's logit."""
    y = np.array(labels, np.int64)
    none = {"table": np.zeros(BUCKETS, np.float32), "bias": 0.0, "scale": 0.0, "shift": -50.0}
    if not (0 < y.sum() < len(y)):
        return none
    rng = np.random.default_rng(seed)
    sample = Sample(texts)
    doc = sample.doc
    if not len(doc):
        return none
    # each half of the texts is looked through by what the other half teaches
    logit, half = np.zeros(len(doc)), doc % 2
    for side in (0, 1):
        table, bias = _fit_windows(y[doc], sample, np.flatnonzero(half != side), rng, max(2, epochs // 2))
        logit[half == side] = sample.logits(table, bias)[half == side]
    # of a toxic text only the windows that look toxic are toxic; a text without any teaches nothing
    use = (y[doc] == 0) | (logit > 0)
    if not (use & (y[doc] == 1)).any():
        use[:] = True
    table, bias = _fit_windows(y[doc], sample, np.flatnonzero(use), rng, epochs)
    score = np.full(len(texts), -np.inf)
    np.maximum.at(score, doc, sample.logits(table, bias))
    score[np.isinf(score)] = bias
    mean, spread = score.mean(), score.std() + 1e-9
    x, a, c = (score - mean) / spread, 1.0, 0.0
    for _ in range(500):  # logistic calibration of the texts' logits
        p = 1 / (1 + np.exp(-np.clip(a * x + c, -40, 40)))
        a, c = a - ((p - y) * x).mean() - 1e-3 * a, c - (p - y).mean()
    return {"table": table.astype(np.float32), "bias": bias, "scale": a / spread, "shift": c - a * mean / spread}


def score_text(text: str | None, model: dict) -> float:
    z = model["scale"] * toxic_logit(text or "", model["table"], model["bias"]) + model["shift"]
    return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def scored(df: DataFrame, model: dict, carried: list[str]) -> DataFrame:
    shared = df.sparkSession.sparkContext.broadcast(model)
    rows = df.select(F.struct(*[F.col(c) for c in carried]).alias("row"), "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [score_text(t, shared.value) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, pa.float64())], names=["row", "score"])

    return rows.mapInArrow(score, f"row {rows.schema['row'].dataType.simpleString()}, score double")


def sampled(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = MAX_FIT_ROWS, max_bytes: int = MAX_FIT_BYTES) -> DataFrame:
    """doc_id, text, toxic of the rows to learn from."""
    known = labels.filter(F.col("toxic").isNotNull() & (crc_fold(F.col("doc_id"), folds) != held)).join(docs.select("doc_id"), "doc_id", "left_semi")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))  # labels of other tables' documents are not broadcast
    sizes = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).join(known, "doc_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes")).first()
    share = min(1.0, max_rows / max(1, sizes["rows"]), max_bytes / max(1, sizes["bytes"] or 0))
    known = known.filter(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(share * (1 << 30)))
    return docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # each label has a row of the sample, so known is bounded by max_rows


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    rows = sampled(docs, labels)

    def trained(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], na_position="first")
        return pd.DataFrame({"model": [pickle.dumps(train([t or "" for t in group["text"]], [int(x > 0) for x in group["toxic"]]))]})

    # numpy learns from the bounded sample in one task, not in the driver
    found = rows.select(F.lit(1).alias("all"), "doc_id", "text", "toxic").groupBy("all").applyInPandas(trained, "model binary").first()
    return pickle.loads(found["model"]) if found else train([], [])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    out = scored(docs, model, ["doc_id"])
    return out.select("row.doc_id", (crc_fold(F.col("row.doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

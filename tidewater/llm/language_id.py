"""Language identification, words first, with backoff to shorter character n-grams.

A known word adds its log frequency in each language. An unseen word backs off to its character
n-grams of the longest order (of MAX_GRAM down to 1) of which any is known, and adds their mean. The
language with the largest sum is predicted; the score is its share under a softmax.

Fitted on at most FIT_ROWS rows of each language, chosen by a hash of the identifier, so a rare language
keeps all its rows; every word and n-gram of these rows is in the model, whose size that bound and the
number of languages limit. A word is a run of letters (category L) of the lower-cased text, in the fit
and in prediction. All documents are scored, over their whole texts.

Defined results: a null text, one without letters (numerals such as one half or roman twelve are none),
or a model without languages gives ``und`` with score 0; ties go to the language that sorts first;
repeated rows each get their result; a null identifier counts as an empty text in the fold and the sample.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc_fold, stored

#: Labelled rows of a language that the model is fitted on, about.
FIT_ROWS = 1_000
MAX_GRAM = 4
#: Unseen words whose sums a task keeps.
KEPT_WORDS = 100_000
#: A document of the pipeline stays if its language has so much of the score.
LEAST_SCORE = 0.5
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
#: The same runs of lower-cased texts of code points up to U+00FF, class written out.
_NARROW = re.compile(r"[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+")
_WIDE = re.compile(r"[^\x00-\xff]")
LETTERS_SQL = r"(\p{L}+)"


def letter_runs(text: str) -> list[str]:
    """The words of a text."""
    low = text.lower()
    return (LETTERS if _WIDE.search(low) else _NARROW).findall(low)


def sampled(rows: DataFrame, a_language: int = FIT_ROWS) -> tuple[DataFrame, list[str]]:
    """About so many rows of each language, all of a language with fewer; and the languages in order."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
    total = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(total)
    of = F.create_map(*[F.lit(x) for lang in langs for x in (lang, total[lang])]) if langs else F.create_map(F.lit(""), F.lit(1))
    of = F.get(F.map_values(F.map_filter(of, lambda lang, n: lang == F.col("lang"))), F.lit(0)).cast("long")
    return rows.filter(F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), of) < a_language), langs  # by text too: identifiers may be null or repeated


def _grams(padded: Column, k: int) -> Column:
    """k and g of every n-gram of k characters. (A lambda with a default would be given the index as its second argument.)"""
    starts = F.when(F.length(padded) >= k, F.sequence(F.lit(1), F.length(padded) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), F.substring(padded, i, F.lit(k)).alias("g")))


def fit(rows: DataFrame, a_language: int = FIT_ROWS) -> dict:
    """The model from rows of text and lang: languages, and log frequencies of words and n-grams by order."""
    rows, langs = sampled(rows.select("doc_id", "text", "lang"), a_language)
    words = rows.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(LETTERS_SQL), F.lit(1))).alias("g")).groupBy("lang", "g").agg(F.count(F.lit(1)).alias("n"))
    words = stored(words, "language-words")
    cut = F.flatten(F.array(*[_grams(F.concat(F.lit("<"), F.col("g"), F.lit(">")), k) for k in range(1, MAX_GRAM + 1)]))
    grams = words.select("lang", "n", F.explode(cut).alias("x")).groupBy("lang", "x.k", "x.g").agg(F.sum("n").alias("n"))
    table = words.select("lang", F.lit(0).alias("k"), "g", "n").unionByName(grams).toArrow()
    number = {lang: i for i, lang in enumerate(langs)}
    order, count = table.column("k").to_numpy(), table.column("n").to_numpy()
    at = np.array([number[x] for x in table.column("lang").to_pylist()], np.int64)
    index: list[dict[str, int]] = []
    parts = []
    for k in range(MAX_GRAM + 1):
        use = np.flatnonzero(order == k)
        known: dict[str, int] = {}
        which = np.array([known.setdefault(g, len(known)) for g in table.column("g").take(use).to_pylist()], np.int64)
        matrix = np.zeros((len(known), len(langs)))
        np.add.at(matrix, (which, at[use]), count[use])
        parts.append(np.log((matrix + 0.5) / (matrix.sum(0) + 0.5 * (len(known) + 1))).astype(np.float32))
        index.append(known)
    return {"langs": langs, "index": index, "rows": parts}


def word_evidence(word: str, model: dict) -> np.ndarray:
    """What a word adds for each language."""
    index, rows = model["index"], model["rows"]
    known = index[0].get(word)
    if known is not None:
        return rows[0][known]
    padded = f"<{word}>"
    for order in range(min(MAX_GRAM, len(padded)), 0, -1):
        found = [v for i in range(len(padded) - order + 1) if (v := index[order].get(padded[i : i + order])) is not None]
        if found:
            return rows[order][found].mean(0)
    return np.zeros(len(model["langs"]), np.float32)


class Seen:
    """What words add: the model's words, and at most KEPT_WORDS unseen ones that were met."""

    def __init__(self, model: dict):
        known = model["rows"][0]
        self.model, self.at, self.full = model, dict(model["index"][0]), len(known) + KEPT_WORDS
        self.rows = np.concatenate([known, np.zeros((KEPT_WORDS, known.shape[1]), np.float32)])

    def total(self, words: list[str]) -> np.ndarray:
        found = list(map(self.at.get, words))
        other = np.zeros(self.rows.shape[1])
        if None in found:
            for i, w in enumerate(words):
                if found[i] is None and (n := self.at.get(w)) is not None:
                    found[i] = n
                elif found[i] is None:
                    evidence = word_evidence(w, self.model)
                    if len(self.at) < self.full:
                        n = self.at[w] = found[i] = len(self.at)
                        self.rows[n] = evidence
                    else:
                        other += evidence
            found = [n for n in found if n is not None]
        return self.rows[found].sum(0, dtype=np.float64) + other


def predict(text: str | None, seen: Seen) -> tuple[str, float]:
    words = letter_runs(text) if text else []
    langs = seen.model["langs"]
    if not words or not langs:
        return UNKNOWN, 0.0
    total = sum(seen.total(words[at : at + 10_000]) for at in range(0, len(words), 10_000))
    best = int(total.argmax())
    return langs[best], float(1 / np.exp(np.maximum(total - total[best], -700)).sum())


def predicted(df: DataFrame, model: dict, carried: list[str]) -> DataFrame:
    """df's carried columns as a struct ``row``, with lang_pred and score."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    own = "text" in carried  # the text then travels once
    rows = df.select(F.struct(*[F.col(c) for c in carried]).alias("row"), *([] if own else ["text"]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen(shared.value)
        for batch in batches:
            texts = batch.column("row").field(carried.index("text")) if own else batch.column("text")
            out = [predict(t.as_py(), seen) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=["row", "lang_pred", "score"])

    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(score, f"row {kind}, lang_pred string, score double")


def training_rows(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    return docs.filter(crc_fold(F.col("doc_id"), folds) != held)


def language_report(docs: DataFrame) -> DataFrame:
    model = fit(training_rows(docs))
    held: Column = crc_fold(F.col("row.doc_id"), 4) == 2
    return predicted(docs.select("doc_id", "text"), model, ["doc_id"]).select("row.doc_id", held.alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, keep: list[str] | None = None, least: float = LEAST_SCORE) -> DataFrame:
    """The documents, with their own columns, whose predicted language is one of ``keep`` (None: any learned one).

    Texts without letters go, and those of which no language has the share ``least`` of the score.
    """
    model = fit(training_rows(docs))
    wanted = (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)
    if keep is not None:
        wanted &= F.col("lang_pred").isin(keep)
    return predicted(docs, model, docs.columns).filter(wanted).select("row.*")

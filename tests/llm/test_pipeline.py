"""The pipeline's stages, each one on its predecessor's rows, against brute force."""

from collections import Counter

import numpy as np
import public_tokenizers
import regex
import tiktoken

import corpus_pipeline
from tests.llm.test_operators import SCHEMA, classes, low, make_rows
from tidewater.llm import mixing, simhash
from tidewater.llm.byte_bpe import token_bytes


def test_stages(spark, tmp_path):
    rows = [r for r in make_rows() if r[0] >= 0]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, SCHEMA).write.parquet(path)
    docs = spark.read.parquet(path)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact", "near", "mix", "tokens"]
    after = {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"out-{i}"))
        now = spark.read.parquet(str(tmp_path / f"out-{i}"))
        after[name] = now.collect()
        if name != "tokens":
            assert now.columns == list(docs.columns)
            docs = now
    assert Counter(r["doc_id"] for r in after["language"]) == Counter(r[0] for r in rows if regex.search(r"\p{L}", r[1] or ""))
    texts = {}
    for r in after["language"]:
        texts.setdefault(low(r["text"]), []).append(r["doc_id"])
    assert Counter(r["doc_id"] for r in after["exact"]) == Counter(max(x) for x in texts.values())
    # near copies: what stays is one row of each group of the links that the operator's own fingerprints have
    prints = {r["doc_id"]: simhash.near_prints(r["text"]) for r in after["exact"]}
    shared = lambda x, y: any(((int(a ^ b) >> at & (1 << n) - 1).bit_count() <= 1) for a, b in zip(x[1:], y[1:], strict=True) for at, n in simhash.LANE_SEGMENTS)
    of = classes(prints, lambda a, b: int(prints[a][0] ^ prints[b][0]).bit_count() <= simhash.NEAR_BITS and shared(prints[a], prints[b]))
    least = {}
    for i, k in of.items():
        least[k] = min(i, least.get(k, i))
    assert sorted(r["doc_id"] for r in after["near"]) == sorted(least.values()) and len(least) < len(of)
    times = Counter()
    for r in mixing.mixed(spark.read.parquet(str(tmp_path / "out-2"))).collect():
        times[r["doc_id"]] += r["times"]
    assert Counter(r["doc_id"] for r in after["mix"]) == +times
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(token_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")))}, special_tokens={})
    want = Counter((r["doc_id"], tuple(enc.encode_ordinary(r["text"]))) for r in after["mix"])
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in after["tokens"]) == want
    assert np.all([r["token_ids"] is not None for r in after["tokens"]])

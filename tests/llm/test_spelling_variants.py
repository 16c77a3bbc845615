"""Spelling variants against all pairs in plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from tests.llm.test_operators import SCHEMA, make_rows, none  # noqa: F401
from tidewater.llm import spelling_variants as sv


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected_vocabulary(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    return {w: k for w, k in n.items() if k >= 2}


def expected(words):
    near = {w: [x for x in words if one_apart(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda x: (-words[x], x))
            form[w] = best if words[best] >= 10 * words[w] else None
    out = []
    for w in words:
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, words[w], len(near[w]), words[f] if f else None))
    return sorted(out, key=repr)


def vocabulary_rows():
    rng = random.Random(5)
    stems = ["".join(rng.choice("aabcé") for _ in range(rng.randrange(7, 12))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abcdefgh" * 40, "ÀÀÀÀÀÀÀ"]
    texts = []
    for k, s in enumerate(stems):
        texts += [s] * (200 if k % 3 == 0 else 2)
        for _ in range(6):
            i = rng.randrange(len(s))
            texts += [rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice("abÿ") + s[i:], s[:i] + rng.choice("abÿ") + s[i + 1 :]])] * rng.choice([2, 15])
    texts += ["chainaaaa"] * 2 + ["chainaaab"] * 30 + ["chainaabb"] * 400  # a form of a form
    rng.shuffle(texts)
    return [(None if k % 40 == 0 else k, " ".join(texts[k : k + 30]).replace("a", "A", k % 3) + ("." if k % 2 else ""), None, None, None, "r", "d") for k in range(0, len(texts), 30)]


@pytest.mark.parametrize("chunk", [sv.CHUNK, 40, 3])
def test_against_all_pairs(spark, chunk):
    rows = vocabulary_rows() + [(1, None, None, None, None, "r", "d"), (2, "", None, None, None, "r", "d")]
    docs = spark.createDataFrame(rows + rows[:3], SCHEMA).repartition(3)
    words = expected_vocabulary(rows + rows[:3])
    want = expected(words)
    got = sv.variant_report(docs, chunk=chunk)
    assert sorted(map(tuple, got.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=repr) == want
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] and r[1] != r[2] for r in want)


def test_trie_in_slices(monkeypatch):
    """Few active pairs at once, and no branch above the least depth."""
    monkeypatch.setattr(sv, "PAIRS", 5)
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randrange(3, 7))) for _ in range(150)})
    for depth in (0, 2):
        import numpy as np

        got = Counter()
        for a, b in sv.Trie(words).near(np.full(len(words), depth)):
            got.update(tuple(sorted((words[x], words[y]))) for x, y in zip(a, b, strict=True) if x >= 0 and y >= 0)
        common = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        want = {(a, b) for a in words for b in words if a < b and one_apart(a, b) and common(a, b) >= depth}
        assert set(got) == want and max(got.values()) == 1  # each pair once


def test_empty(spark, none):  # noqa: F811
    assert sv.variant_report(none).count() == 0
    docs = spark.createDataFrame([r for r in make_rows() if r[1] is None or len(r[1]) < 3], SCHEMA)
    assert sv.variant_report(docs).count() == 0
    with pytest.raises(ValueError):
        sv.near_words(docs.selectExpr("text AS word", "1L AS n"), least=2)

"""MinHash with odd sketches: the report against all pairs of full sets, and the sketch's own estimates."""

import random
from collections import defaultdict

import numpy as np
import pytest

from tests.llm.test_operators import SCHEMA, classes, low, make_rows, none  # noqa: F401
from tidewater.llm import odd_sketch as odd


def shingles(text, n=3):
    words = [w for w in low(text).replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))) if words else frozenset()


def expected(rows):
    sets = [shingles(r[1]) for r in rows]
    of = classes(range(len(rows)), lambda a, b: bool(sets[a]) and bool(sets[b]) and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]))
    least = defaultdict(lambda: None)
    for i, k in of.items():
        if rows[i][0] is not None:
            least[k] = rows[i][0] if least[k] is None else min(least[k], rows[i][0])
    return sorted(((rows[i][0], len(sets[i]), least[of[i]] if sets[i] else rows[i][0], rows[i][0] == (least[of[i]] if sets[i] else rows[i][0])) for i in range(len(rows))), key=repr)


def near_rows():
    """Chains of copies, each with a few words changed, so that similarities lie on both sides of the limit."""
    rng = random.Random(8)
    rows, at = [], 10_000
    for _ in range(12):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        for _ in range(14):
            if rng.random() < 0.5:
                words = list(words)
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            at += 1
            rows.append((at * 37 % 9973, " ".join(words), "en", "a", 1, "r", "d"))
    return rows


@pytest.mark.parametrize("block", [odd.BLOCK, 4])
def test_against_all_pairs(spark, block):
    rows = near_rows() + make_rows() + [(None, "no id at all here", None, None, None, "r", "d"), (None, "NO id at all here", None, None, None, "r", "d"), (77, "no ID at all here", None, None, None, "r", "d"), (None, None, None, None, None, "r", "d")]
    got = odd.odd_sketch_report(spark.createDataFrame(rows, SCHEMA).repartition(4), block=block)
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr) == expected(rows)
    sets = [shingles(r[1]) for r in near_rows()]
    likeness = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i]]
    assert sum(0.75 < x < 0.85 for x in likeness) > 30 and sum(0.85 <= x < 1 for x in likeness) > 30


def test_second_round_finds_what_the_first_leaves(spark):
    """A bucket's least node is like none of the others, of which two are linked and a third is like one of them."""
    sketch, far, token = [0] * 8, [-1] * 8, lambda *x: np.array(x, np.uint32).tobytes()
    same, other = token(*range(20)), token(*range(100, 120))
    rows = [(5, 4, 80, n, n if n < 3 else 3, far if n == 1 else sketch, other if n == 1 else same) for n in (1, 2, 3, 4)]
    rows += [(6, 2, 40, 8, 8, sketch, same), (6, 2, 40, 9, 8, sketch, same)]
    rows += [(7, 2, 40, 11, 11, sketch, same), (7, 2, 40, 12, 12, sketch, token(*range(4, 24)))]  # alike by sketch only
    members = spark.createDataFrame(rows, "key bigint, n bigint, all bigint, node bigint, root bigint, sketch array<bigint>, tokens binary")
    for block in (2048, 1, 2):
        got = [tuple(r) for r in odd.met_across(members, block=block).collect()]
        assert got and set(got) <= {(2, 3), (2, 4)}


def test_overlaps(monkeypatch):
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(0, 90)).astype(np.uint32)) for _ in range(40)]
    for width in (4096, 7):
        monkeypatch.setattr(odd, "WIDTH", width)
        got = odd.overlaps(sets)
        assert all(got[i, j] == len(np.intersect1d(a, b)) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j)
    assert odd.overlaps([np.array([1, 2], np.uint32), np.array([3], np.uint32)]).sum() == 0


def test_sketches_tell_high_similarities(spark):
    rng = np.random.default_rng(4)
    for likeness in (0.85, 0.9, 0.97):
        told, kept = [], 0
        for _ in range(60):
            n = 2000
            shared = round(2 * n * likeness / (1 + likeness))
            keys = rng.integers(0, 1 << 63, 2 * n, np.uint64)
            one, other = np.unique(keys[:n]), np.unique(keys[n - shared : 2 * n - shared])
            bits = int(np.bitwise_count(odd.odd_sketch(odd.samples(one)) ^ odd.odd_sketch(odd.samples(other))).sum())
            told.append(odd.estimate(bits))
            kept += bits <= odd.MAX_ODD
        assert abs(np.mean(told) - likeness) < 0.02 and kept == 60
    a, b = odd.odd_sketch(odd.samples(np.arange(9, dtype=np.uint64))), odd.odd_sketch(odd.samples(np.arange(5, 30, dtype=np.uint64)))
    frame = spark.createDataFrame([(a.view(np.int64).tolist(), b.view(np.int64).tolist())], "a array<bigint>, b array<bigint>")
    assert frame.select(odd.odd_bits(frame.a, frame.b)).first()[0] == np.bitwise_count(a ^ b).sum() > odd.MAX_ODD


def test_empty(spark, none):  # noqa: F811
    assert odd.odd_sketch_report(none).count() == 0
    blank = spark.createDataFrame([(3, " \n", None, None, None, "r", "d"), (2, None, None, None, None, "r", "d"), (3, "", None, None, None, "r", "d")], SCHEMA)
    assert sorted(map(tuple, odd.odd_sketch_report(blank).collect())) == [(2, 0, 2, True), (3, 0, 3, True), (3, 0, 3, True)]

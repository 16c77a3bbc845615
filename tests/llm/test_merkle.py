"""The Merkle manifest against one built row by row in plain Python."""

import zlib
from collections import defaultdict

import pytest

from tests.llm.test_operators import SCHEMA, make_rows, none, sha  # noqa: F401
from tidewater.llm import merkle


def leaf(row, change=False):
    doc_id, text, lang, source, n_chars = row[:5]
    if change and zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 3 == 0 and text is not None:
        text = text.encode().lower().decode()
    return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def climb(digests, fanout):
    """The last digest and, for each node, its siblings by level."""
    paths, at = [[] for _ in digests], list(range(len(digests)))
    while len(digests) > 1:
        runs = [digests[i : i + fanout] for i in range(0, len(digests), fanout)]
        for k, i in enumerate(at):
            run, place = runs[i // fanout], i % fanout
            paths[k].append(("".join(run[:place]), "".join(run[place + 1 :])))
            at[k] = i // fanout
        digests = [sha("".join(run)) for run in runs]
    return digests[0], paths


def expected(rows, fanout):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in names:
        by[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[name] = climb([leaf(r) for r in by[name]], fanout)
    root, above = climb([trees[n][0] for n in names], fanout)
    out = []
    for name, further in zip(names, above, strict=True):
        for r, path in zip(by[name], trees[name][1], strict=True):
            h = leaf(r, change=True)
            for left, right in path + further:
                h = sha(left + h + right)
            out.append((r[0], leaf(r), trees[name][0], root, sha("".join(a + b for a, b in path + further)), h, h == root))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fanout", [8, 3])
def test_against_plain_python(spark, fanout):
    rows = make_rows() + [(None, "no Id", "en", None, None, "r", "d")] * 3 + [(k, f"Text {k}", f"l{k % 11}é", "a", k, "r", "d") for k in range(5000, 5040)]
    got = merkle.merkle_report(spark.createDataFrame(rows, SCHEMA).repartition(5), fanout)
    want = expected(rows, fanout)
    assert sorted(map(tuple, got.select(COLUMNS).collect()), key=repr) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_small_tables(spark, none):  # noqa: F811
    assert merkle.merkle_report(none).count() == 0
    one = [(4, "A b", None, None, None, "r", "d")]
    got = merkle.merkle_report(spark.createDataFrame(one, SCHEMA)).first()
    assert got["leaf"] == got["subroot"] == got["root"] and got["proof_sha256"] == sha("")
    assert sorted([tuple(got[c] for c in COLUMNS)]) == expected(one, 8)
    same = [(7, "Same", "en", "a", 1, "r", "d")] * 20
    assert sorted(map(tuple, merkle.merkle_report(spark.createDataFrame(same, SCHEMA)).select(COLUMNS).collect()), key=repr) == expected(same, 8)


def test_numbers_do_not_depend_on_partitions(spark):
    rows = [(k, f"t{k}", "en" if k % 3 else None, "a", k, "r", "d") for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    roots = {merkle.merkle_report(docs.repartition(n)).first()["root"] for n in (1, 7)}
    assert len(roots) == 1

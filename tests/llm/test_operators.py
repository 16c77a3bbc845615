"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties and copies."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewater.llm import byte_bpe, chat_format, exact_dedup, fingerprints, language_id, mixing, simhash, substring_dedup, token_files, toxicity
from tidewater.llm.byte_bpe import token_bytes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, digest string"
sha = lambda x: hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()
low = lambda x: (x or "").encode().lower().decode()


def make_rows():
    rng = random.Random(3)
    words = ["the", "of", "and", "élan", "Über", "señor", "naïve", "x1", "don't", "émigré", "b​c", "中文字", "Σίσυφος", "½"]
    line = lambda n: " ".join(rng.choice(words) + rng.choice(["", ".", ",", "!?", "'s"]) + str(rng.randrange(40)) for _ in range(n))
    shared = line(60)
    texts = [line(rng.randrange(1, 120)) for _ in range(60)]
    texts += [texts[0], texts[1], texts[1].upper(), texts[2].swapcase()]
    texts += [line(20) + " " + shared + " " + line(15), shared + "\n" + line(9), shared]
    texts += [None, "", " \t\n", "word", "A", "é", "É", "ab " * 50, "  two\x0bblanks \x1c here now ", "x" * 4000, line(3000), "<|endoftext|> İstanbul ﬁ", "1234567 !!! \r\n\r\n  tail  "]
    texts += [" ".join(texts[3].split()[:-1] + ["changed"]), texts[3] + " more"]
    rows = [(i * 7 % 1000, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", "B", None, "z"]), len(t or ""), "r", "d") for i, t in enumerate(texts)]
    return rows + [rows[5], (-3, texts[6], "en", None, 1, "r", "d")]


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def docs(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def out(df):
    return sorted(map(tuple, df.collect()), key=repr)


def winnow(text, k=fingerprints.K, w=fingerprints.WINDOW):
    words = re.findall(r"[^\x20\x09-\x0D]{1,%d}" % fingerprints.PIECE, low(text))
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] or ([tuple(words)] if words else [])
    return grams


def test_winnowing(spark, docs, rows):
    got = {(r["doc_id"], tuple(r["positions"])): r["hashes"] for r in fingerprints.winnowing(docs).collect()}
    by_id = defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r[1])
    named = {}
    for (doc, at), hashes in got.items():
        grams = winnow(by_id[doc][0])
        assert len(at) == len(set(at)) == len(hashes)
        for p, h in zip(at, hashes, strict=True):
            assert named.setdefault(grams[p], h) == h  # one hash for one k-gram, everywhere
        span = min(len(grams), fingerprints.WINDOW)
        for i in range(len(grams) - span + 1 if grams else 0):  # every window has a chosen k-gram
            assert any(i <= p < i + span for p in at)
    # equal hashes: the rightmost one of each window
    tied = spark.createDataFrame([(1, "ab " * 12)], "doc_id bigint, text string")
    assert fingerprints.winnowing(tied).first()["positions"] == [3, 4, 5, 6, 7]


def edited(rows):
    order = sorted([r for r in rows], key=lambda r: -r[0])
    return order


def test_fingerprint_edits(spark, docs, rows, none):
    got = fingerprints.fingerprint_edits(docs).collect()
    assert len(got) == len(rows)
    ids = Counter(r[0] for r in rows)
    order = sorted(rows, key=lambda r: -r[0])
    same = {}
    for r, n in zip(order, order[1:] + order[:1], strict=True):
        if ids[r[0]] > 1 or ids[n[0]] > 1:
            continue
        text, after = r[1] or "", n[1] or ""
        third = len(text) // 3
        want = text[: len(text) - third] + after[:third]
        g = next(x for x in got if x["doc_id"] == r[0])
        assert (g["n_chars"], g["edited_sha256"]) == (len(text), sha(want))
        assert 0 <= g["near_edited"] <= 1 and 0 <= g["near_next"] <= 1
        same.setdefault(low(text), set()).add(g["fingerprint"])
        same.setdefault(low(want), set()).add(g["edited_fingerprint"])
        if low(text) == low(want):
            assert g["near_edited"] == 1
    assert all(len(x) == 1 for x in same.values())
    assert fingerprints.fingerprint_edits(none).count() == 0
    one = spark.createDataFrame([(None, "a b c d e f g h i")], "doc_id bigint, text string")
    assert fingerprints.fingerprint_edits(one).first()["near_next"] == 1


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: (__import__("pyspark.sql.functions", fromlist=["x"]).length(t) % 5).cast("string")])
def test_exact_dedup(docs, rows, none, digest):
    got = exact_dedup.exact_groups(docs, ["text"], digest).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[low(r[1])].append(r[0])
    assert len(got) == len(rows)
    kept = Counter()
    for g in got:
        ids = groups[low(g["row"]["text"])]
        assert (g["keep_id"], g["group_size"]) == (max(ids), len(ids))
        if g["kept"]:
            kept[low(g["row"]["text"])] += 1
            assert g["doc_id"] == max(ids)
    assert kept == {k: 1 for k in groups}
    stay = exact_dedup.exact_dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)
    assert exact_dedup.exact_dedup_report(none).count() == 0


def test_exact_state_over_batches_and_restart(spark, rows, tmp_path):
    """Three batches, then a second run over more files that goes on from the stored state."""
    source, target = str(tmp_path / "rows"), str(tmp_path / "state")
    frame = spark.createDataFrame([(r[0], sha(low(r[1]))) for r in rows], "doc_id bigint, digest string")
    sizes = Counter(sha(low(r[1])) for r in rows)
    most = defaultdict(list)
    for r in rows:
        most[sha(low(r[1]))].append(r[0])
    parts = frame.randomSplit([0.6, 0.4], 3)
    parts[0].repartition(6).write.parquet(source)
    exact_dedup.update_state(spark, source, frame.schema, target, batches=3)
    some = Counter(r["digest"] for r in parts[0].collect())
    assert {r["digest"]: r["group_size"] for r in exact_dedup.state_of(spark, target).collect()} == some
    parts[1].repartition(4).write.mode("append").parquet(source)
    exact_dedup.update_state(spark, source, frame.schema, target, batches=2)
    assert len([x for x in (tmp_path / "state").iterdir() if x.name.startswith("batch=")]) >= 4
    got = {r["digest"]: (r["group_size"], r["first"]["id"]) for r in exact_dedup.state_of(spark, target).collect()}
    assert got == {d: (n, max(most[d])) for d, n in sizes.items()}


def test_exact_hot_group_and_null_ids(spark):
    rows = [(i, "Same Text", None, None, 0, "", "") for i in range(400)] + [(None, "same text", None, None, 0, "", ""), (None, "only", None, None, 0, "", ""), (None, None, None, None, 0, "", "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_dedup.exact_groups(df).collect()
    assert Counter((r["keep_id"], r["group_size"]) for r in got) == {(399, 401): 401, (None, 1): 2}
    assert Counter(r["text"] for r in exact_dedup.exact_dedup(df).collect()) == {"Same Text": 1, "only": 1, None: 1}


def simhash_of(text):
    words = low(text).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(nodes, linked):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if linked(a, b):
                root[find(a)] = find(b)
    return {n: find(n) for n in nodes}


def test_simhash(spark, docs, rows, none):
    fp = [(r[0], simhash_of(r[1])) for r in rows]
    of = classes({x for _, x in fp}, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, x in fp:
        least[of[x]] = min(i, least.get(of[x], i))
    assert out(simhash.near_dup_report(docs)) == sorted([(i, f"{x:016x}", least[of[x]]) for i, x in fp], key=repr)
    assert simhash.near_dup_report(none).count() == 0
    nameless = spark.createDataFrame([(None, "a b c d e"), (None, None), (4, "A b c d e"), (4, "")], "doc_id bigint, text string")
    assert sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_dup_report(nameless).collect()) == [(0, 4), (0, 4), (4, 4), (4, 4)]


def shingles(text, n=5):
    words = low(text).split()
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)}


def test_near_dedup(spark, docs, none):
    """Texts with 0.9 of their shingles in common meet, those with less than a half do not."""
    rng = random.Random(8)
    word = lambda: f"w{int(rng.paretovariate(0.7)) % 5000}"
    texts = [[word() for _ in range(rng.randrange(60, 400))] for _ in range(120)]
    copies = [list(t) for t in texts[:60]]
    for t in copies:
        for _ in range(max(1, len(t) // 120)):
            t[rng.randrange(len(t))] = "changed"
    half = [t[: len(t) // 3] + [word() for _ in range(len(t))] for t in texts[60:90]]
    all_texts = [" ".join(t) for t in texts + copies + half]
    df = spark.createDataFrame([(i, t, "en", None, 0, "r", "d") for i, t in enumerate(all_texts)] + [(900, None, None, None, 0, "", ""), (901, "", None, None, 0, "", "")], SCHEMA)
    stay = {r["doc_id"] for r in simhash.near_dedup(df).collect()}
    near = [i for i in range(60) if len(a := shingles(all_texts[i]) & shingles(all_texts[120 + i])) >= 0.85 * len(shingles(all_texts[i]) | shingles(all_texts[120 + i])) and a]
    assert len(near) > 40 and sum(120 + i not in stay for i in near) >= 0.9 * len(near)
    assert set(range(120)) <= stay and set(range(180, 210)) <= stay and {900, 901} & stay == {900}
    assert simhash.near_dedup(docs).columns == docs.columns
    assert simhash.near_dedup(none).count() == 0


@pytest.mark.parametrize("run", [simhash.RUN, 12])
@pytest.mark.parametrize("most", [2, 4, 5])
def test_simhash_links_lose_nothing(spark, run, most):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)] + [0, (1 << 64) - 1]
    prints = set(base)
    for x in base:
        for _ in range(60):
            y = x
            for b in rng.sample(range(64), rng.randrange(1, 7)):
                y ^= 1 << b
            prints.add(y)
    prints |= {rng.getrandbits(42) | 5 << 42 for _ in range(40)}  # one segment in common, far apart else
    with pytest.raises(ValueError):
        simhash.links(None, 6)
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in prints]
    df = spark.createDataFrame(signed, "fp bigint")
    got = {r["node"] & ((1 << 64) - 1): r["root"] & ((1 << 64) - 1) for r in simhash.components(simhash.links(df, most, run)).collect()}
    want = classes(prints, lambda a, b: (a ^ b).bit_count() <= most)
    for a in prints:
        for b in prints:
            assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b) if a != b else True)


def test_mixing(spark, docs, rows, none):
    got = mixing.mix_report(docs).collect()
    size = lambda t: len((t or "").encode().split())
    total = Counter()
    for r in rows:
        total[r[3]] += size(r[1])
    names = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, budget, open_ = {}, 1.5 * sum(total.values()), set(names)
    while True:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * total[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * total[s]
            budget -= target[s]
        open_ -= over
    target |= {s: weight[s] * level for s in open_}
    by_id = {r[0]: r for r in rows}
    taken, most = Counter(), Counter()
    for g in got:
        s = by_id[g["doc_id"]][3]
        assert g["size"] == size(by_id[g["doc_id"]][1]) and g["source_size"] == total[s]
        assert g["target"] == pytest.approx(target[s]) and g["size"] * 2 >= g["taken"]
        taken[s] += g["taken"]
        most[s] = max(most[s], g["size"])
    assert all(abs(taken[s] - target[s]) <= most[s] for s in names)
    assert out(mixing.mix_report(docs)) == sorted(map(tuple, got), key=repr)
    repeated = mixing.mix(docs)
    assert repeated.columns == docs.columns
    words = Counter()
    for r in repeated.collect():
        words[r["source"]] += size(r["text"])
    assert words == +taken
    assert mixing.mix_report(none).count() == 0


def spelled_letters(text):
    """Runs of letters, one character at a time."""
    runs, run = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c).startswith("L"):
            run += c
        elif run:
            runs.append(run)
            run = ""
    return runs


def scored_languages(texts, langs, asked):
    """An independent scorer: counts by language, words first, the longest known n-grams for other words."""
    counts = [defaultdict(Counter) for _ in range(5)]
    for text, lang in zip(texts, langs, strict=True):
        for w in spelled_letters(text):
            counts[0][w][lang] += 1
            for k in range(1, 5):
                for i in range(len(w) + 3 - k):
                    counts[k][f"<{w}>"[i : i + k]][lang] += 1
    names = sorted(set(langs))
    sums = [{x: sum(c[x] for c in table.values()) for x in names} for table in counts]
    part = lambda k, g, x: math.log((counts[k][g][x] + 0.5) / (sums[k][x] + 0.5 * (len(counts[k]) + 1)))
    out = []
    for text in asked:
        score = dict.fromkeys(names, 0.0)
        words = spelled_letters(text or "")
        for w in words:
            order, found = 0, [w] if w in counts[0] else []
            for k in range(min(4, len(w) + 2), 0, -1):
                if found:
                    break
                order, found = k, [g for i in range(len(w) + 3 - k) if (g := f"<{w}>"[i : i + k]) in counts[k]]
            for x in names:
                score[x] += sum(part(order, g, x) for g in found) / max(1, len(found))
        best = max(names, key=lambda x: (score[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(v - score[best]) for v in score.values())) if words else ("und", 0.0))
    return out


def test_language(spark, docs, rows, none):
    en = "the house and the garden of a man with some water in it"
    fr = "la maison et le jardin pour un homme avec de l'eau dans une rue"
    learned = [(i + 1, en if i % 2 else fr + " élan " * (i % 3), "en" if i % 2 else "fr", None, 0, "", "") for i in range(40)]
    asked = ["The gardens", None, "12 %", "hommes jardins", "½ ² 3 Ⅷ", "\u0301 \u0300", "ÉLAN vital", "中文字", "x\u0301y zzz", "it" * 500, "la the 中 élan's Σίσυφος"]
    df = spark.createDataFrame(learned + [(900 + i, t, None, None, 0, "", "") for i, t in enumerate(asked)], SCHEMA)
    model = language_id.fit(df.filter("doc_id < 900"))
    said = {r["doc_id"]: r for r in language_id.predicted(df, model, ["doc_id"]).select("row.doc_id", "lang_pred", "score").collect()}
    want = scored_languages([r[1] for r in learned], [r[2] for r in learned], asked)
    for i, (lang, score) in enumerate(want):
        assert said[900 + i]["lang_pred"] == lang, asked[i]
        assert said[900 + i]["score"] == pytest.approx(score, abs=1e-4)
    assert [said[900 + i]["lang_pred"] for i in range(6)] == ["en", "und", "und", "fr", "und", "und"]
    report = language_id.language_report(docs).collect()
    assert len(report) == len(rows) and {r["held_out"] for r in report} == {True, False}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in report)
    assert language_id.language_report(none).count() == 0
    nameless = spark.createDataFrame([(None, en, "en", None, 0, "", ""), (None, None, None, None, None, None, None), (1, fr, "fr", "s", 1, "", "")], SCHEMA)
    assert sorted((r["lang_pred"], r["held_out"]) for r in language_id.language_report(nameless).collect()) == [("en", False), ("fr", zlib.crc32(b"1") % 4 == 2), ("und", False)]


def test_language_filter(spark, docs, rows, none):
    en, fr = "the house and the garden of a man", "la maison et le jardin pour un homme"
    df = spark.createDataFrame([(i, (en, fr, "½ Ⅷ", None)[i % 4], ("en", "fr", None, "en")[i % 4], None, 0, "", "") for i in range(60)], SCHEMA)
    stay = lambda **k: {r["doc_id"] % 4 for r in language_id.with_language(df, **k).collect()}
    assert stay() == {0, 1} and stay(keep=["fr"]) == {1} and stay(keep=[]) == set() and stay(least=1.1) == set()
    assert language_id.with_language(docs).columns == docs.columns
    assert language_id.with_language(none).count() == 0


def test_language_sample_keeps_rare_languages(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "'the word' AS text", "CASE WHEN id = 7 THEN 'rare' WHEN id % 2 = 0 THEN 'en' ELSE 'fr' END AS lang")
    got = Counter(r["lang"] for r in language_id.sampled(rows, 100)[0].collect())
    assert got["rare"] == 1 and 60 < got["en"] < 140 and 60 < got["fr"] < 140


def test_language_sample_of_null_and_repeated_ids(spark):
    for doc_id in ("CAST(NULL AS BIGINT)", "5L"):
        for n in (1000, 1900, 2900):
            rows = spark.range(n).selectExpr(f"{doc_id} AS doc_id", "concat('the word ', id) AS text", "'en' AS lang")
            assert 220 < language_id.sampled(rows, 300)[0].count() < 380


def test_language_held_out_accuracy(spark):
    from pathlib import Path

    table = Path("/root/testdata/sf0.01/documents.parquet")
    if not table.exists():
        pytest.skip("no test tables")
    docs = spark.read.parquet(str(table))
    real = {r["doc_id"]: r["lang"] for r in docs.filter("lang is not null and text is not null").select("doc_id", "lang").collect()}
    told = [r["lang_pred"] == real[r["doc_id"]] for r in language_id.language_report(docs).filter("held_out").collect() if r["doc_id"] in real]
    assert len(told) > 100 and np.mean(told) >= 0.98


def test_bpe(docs, rows, none):
    ranks = {t: i for i, t in enumerate(token_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        want.append((r[0], len(ids), sha(np.array(ids, "<u4").tobytes()), sha(r[1] or "")))
    assert out(byte_bpe.bpe_report(docs)) == sorted(want, key=repr)
    back = byte_bpe.decode_documents(byte_bpe.encode_documents(docs))
    assert Counter((r["doc_id"], r["text"]) for r in back.collect()) == Counter((r[0], r[1] or "") for r in rows)
    assert byte_bpe.bpe_report(none).count() == 0


def test_bpe_rare_words_only(docs, rows):
    few = byte_bpe.encoded_rows(docs.select("doc_id", "text"), ["doc_id"], public_tokenizers.path("byte_bpe_50k.tiktoken"), hot_limit=3, hot_least=1)
    table = token_bytes(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    got = Counter((r["row"]["doc_id"], byte_bpe.decoded(bytes(r["ids"]), table).decode()) for r in few.collect())
    assert got == Counter((r[0], r[1] or "") for r in rows)


def test_bpe_patterns_agree():
    rng = random.Random(9)
    signs = [chr(c) for c in range(256)] + list("'stredvml  \n\n") * 9
    for _ in range(3000):
        t = "".join(rng.choice(signs) for _ in range(rng.randrange(1, 40)))
        assert byte_bpe._NARROW.findall(t) == byte_bpe._EXACT.findall(t)


def test_substring(docs, rows, none):
    w = 35
    texts = [(r[1] or "").encode().split() for r in rows]
    count = Counter(tuple(t[i : i + w]) for t in texts for i in range(len(t) - w + 1))
    want = []
    for r, t in zip(rows, texts, strict=True):
        gone = set()
        for i in range(len(t) - w + 1):
            if count[tuple(t[i : i + w])] > 1:
                gone |= set(range(i, i + w))
        want.append((r[0], len(t), len(gone), sha(b" ".join(x for i, x in enumerate(t) if i not in gone))))
    assert any(x[2] for x in want)
    assert out(substring_dedup.substring_report(docs)) == sorted(want, key=repr)
    assert substring_dedup.substring_report(none).count() == 0


@pytest.mark.parametrize("window", [1, 5, 9, 12, 35, 80])
def test_substring_levels_and_blocks(docs, rows, window, monkeypatch):
    """Other windows, with one to four levels, and documents dealt to many blocks."""
    monkeypatch.setattr(substring_dedup, "BLOCK_WORDS", 200)
    texts = [(r[1] or "").encode().split() for r in rows]
    count = Counter(tuple(t[i : i + window]) for t in texts for i in range(len(t) - window + 1))
    want = []
    for r, t in zip(rows, texts, strict=True):
        gone = {j for i in range(len(t) - window + 1) if count[tuple(t[i : i + window])] > 1 for j in range(i, i + window)}
        want.append((r[0], len(t), len(gone)))
    got = substring_dedup.substring_dedup(docs.select("doc_id", "text"), ["doc_id"], window).select("row.doc_id", "n_words", "n_removed")
    assert out(got) == sorted(want, key=repr)


def test_token_files(spark, docs, rows, none, tmp_path):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    at, want = 0, []
    for r in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = [*tok.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert out(token_files.token_file_rows(docs)) == sorted(want, key=repr)
    token_files.write_tokens(docs.select("doc_id", "text"), str(tmp_path / "small"), shard_ids=300)
    assert out(token_files.read_tokens(spark, str(tmp_path / "small")).drop("ids")) == sorted(want, key=repr)
    assert token_files.token_file_rows(none).count() == 0


def test_tokenizer_shortcut():
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    signs = [chr(c) for c in range(32, 256)] + list("'stredvml  \n\t…–’“€ŒÀéß")
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(1, 60))) for _ in range(3000)]
    for t, ids in zip(texts, token_files.encode_texts(pa.array(texts), public_tokenizers.path("word_bpe_49k.json")), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_repair():
    rng = np.random.default_rng(1)
    for n, kinds in ((0, 5), (1, 5), (5000, 3), (20000, 50), (30000, 3000)):
        ids = rng.integers(0, kinds, n).astype(np.uint32)
        seq, rules = token_files.repair(ids)
        assert (token_files.expanded(seq, rules) == ids).all()
        lengths = token_files.rule_lengths(rules)
        assert int(token_files.expansion_lengths(seq, lengths).sum()) == n
        left = Counter((a, b) for a, b in zip(seq[:-1].tolist(), seq[1:].tolist(), strict=True) if token_files.END not in (a, b))
        assert not left or max(left.values()) < token_files.LEAST_COUNT  # until no frequent pair is left
        if n > 4000 and kinds < 100:
            assert len(seq) + 2 * len(rules) < n


def test_repair_cost_and_result(monkeypatch):
    """The grammar of a plain version; pairs that don't fit into 64 bits with their place; pairs counted in all rounds."""

    def plain(ids, least=token_files.LEAST_COUNT):
        seq, rules = ids.tolist(), []
        while True:
            count = Counter(x for x in zip(seq[:-1], seq[1:], strict=True) if token_files.END not in x)
            names = {x: token_files.FIRST_RULE + len(rules) + i for i, x in enumerate(sorted(x for x in count if count[x] >= least))}
            if not names:
                return seq, rules
            rules += names
            out, i = [], 0
            while i < len(seq):
                name = names.get(tuple(seq[i : i + 2]))
                if name is None:
                    out.append(seq[i])
                    i += 1
                    continue
                # of frequent pairs that overlap in a row every second one, so the next place is not looked at
                out.append(name)
                i += 2
            seq = out

    rng = np.random.default_rng(3)
    words = rng.permutation(40_000)
    for n, most in ((0, 2), (1, 2), (2, 2), (4000, 2), (4000, 9), (6000, 400), (9000, 40_000)):
        ids = words[np.minimum(rng.zipf(1.3, n), most) - 1].astype(np.uint32)
        seq, rules = token_files.repair(ids)
        want, named = plain(ids)
        assert (seq.tolist(), list(map(tuple, rules.tolist()))) == (want, named)
        lengths = token_files.bounds(token_files.rule_lengths(rules).astype(np.int64))
        whole = token_files.expanded(np.arange(len(rules), dtype=np.uint32) + token_files.FIRST_RULE, rules)
        assert (token_files.unrolled(seq, whole, lengths) == ids).all()
    one, two = (rng.integers(0, 3, 500).astype(np.uint32) * np.uint32(2**31 - 1) for _ in "ab")
    at, begin = token_files.by_pair(one, two, np.arange(500))
    told = [(one[x[0]], two[x[0]], sorted(x.tolist())) for x in np.split(at, begin[1:])]
    assert told == [(a, b, np.flatnonzero((one == a) & (two == b)).tolist()) for a, b in sorted(set(zip(one, two, strict=True)))]

    sizes = rng.integers(1, 7, 50_000)
    pieces = rng.integers(2, 40_000, sizes.sum()).astype(np.uint32)
    ids, _ = token_files.taken(pieces, token_files.bounds(sizes), (50_000 ** rng.random(60_000)).astype(int) - 1)
    counted, by_pair = [], token_files.by_pair
    monkeypatch.setattr(token_files, "by_pair", lambda one, two, at: counted.append(len(at)) or by_pair(one, two, at))
    seq, rules = token_files.repair(ids)
    assert (token_files.expanded(seq, rules) == ids).all()
    assert len(counted) > 3 and sum(counted) < 2 * len(ids)  # whole sequences, as counted before, come to over 3 times the ids


def test_vocabulary_keeps_frequent_words(monkeypatch):
    """A full vocabulary drops the words met last; those met first are not encoded again."""
    monkeypatch.setattr(token_files, "KEPT_WORDS", 60)
    path = public_tokenizers.path("word_bpe_49k.json")
    full, found = Tokenizer.from_file(path), token_files.Vocabulary(path)
    rng = random.Random(5)
    common = ["garden", "l'été", "don't", "straße", "h\xf4tel,", "42nd"]
    met, sizes = Counter(), []
    learn = found._learn

    def watched():
        met.update(list(found.places)[len(found.starts) - 1 :])
        learn()

    monkeypatch.setattr(found, "_learn", watched)
    for i in range(12):
        rare = ["".join(rng.choice("abcdefgé") for _ in range(9)) for _ in range(25)]
        texts = [" ".join(common), f"  {' '.join(rare)}\n", "", " \t", "".join(rare) * 40 if i == 7 else "İx"]
        for t, ids in zip(texts, found.encode(pa.array(texts)), strict=True):
            assert ids.tolist() == full.encode(t, add_special_tokens=False).ids, t
        sizes.append(len(found.places))
    assert max(sizes) < 100 and min(np.diff(sizes)) < 0  # it was full more than once
    assert met["garden"] == met["straße"] == met["été"] == 1
    assert found.encode(pa.array([], pa.string())) == []


def test_read_document(monkeypatch):
    """Random access to whole documents and parts of them, over several frames and with the end id inside texts."""
    monkeypatch.setattr(token_files, "FRAME", 4096)
    rng = np.random.default_rng(2)
    texts = [rng.integers(1 if i % 2 else 2, 9 if i % 3 else 30_000, n).astype(np.uint32) for i, n in enumerate((0, 1, 90_000, 3, 120_000, 0, 77))]
    names = [c.split()[0] for c in token_files.SHARD.split(", ")]
    shard = dict(zip(names, token_files._shard(0, 0, list(range(len(texts))), texts), strict=True))
    assert len(np.frombuffer(shard["frames"], np.int64)) > 3
    for i, x in enumerate(texts):
        whole = [*x.tolist(), token_files.END]
        assert token_files.read_document(shard, i).tolist() == whole
        for first, last in ((0, 1), (5, 40), (len(x) // 2, len(x) // 2 + 7), (len(x), None), (10**6, None)):
            assert token_files.read_document(shard, i, first, last).tolist() == whole[first:last]


def test_toxicity(spark, docs, rows, none):
    rng = random.Random(2)
    clean = ["garden", "house", "river", "music", "window", "letter", "silver", "candle", "forest", "summer"]
    bad = ["idiot", "moron", "worthless"]
    texts = [" ".join(rng.choice(clean) for _ in range(rng.randrange(5, 200))) for _ in range(300)]
    labels = [int(i % 6 == 0) for i in range(300)]
    texts = [t + " " + " ".join(rng.sample(bad, 2)) + " " + rng.choice(clean) if y else t for t, y in zip(texts, labels, strict=True)]
    model = toxicity.train(texts, labels)
    assert toxicity.score_text("what an idiot you are", model) > 0.5 > toxicity.score_text("the garden of the house", model)
    assert toxicity.score_text("house garden idioot river", model) > toxicity.score_text("house garden river river", model)
    long = " ".join(clean * 3000)
    assert toxicity.score_text(long, model) < 0.5 < toxicity.score_text(long + " moron idiot " + long, model)
    assert 0 <= toxicity.score_text(None, model) == toxicity.score_text("", model) < 0.5
    marked = spark.createDataFrame([(r[0], 1, int(i % 3 == 0)) for i, r in enumerate(rows)] + [(None, None, None)], "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity_report(docs, marked).collect()
    assert len(got) == len(rows) and all(r["predicted"] == int(r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert toxicity.toxicity_report(none, marked).count() == 0
    assert {r["score"] for r in toxicity.toxicity_report(docs, marked.limit(0)).collect()} < {x / 1e9 for x in range(2)} | {r["score"] for r in toxicity.toxicity_report(docs, marked.limit(0)).limit(1).collect()} | {0.0}


def test_toxicity_scores_against_brute_force():
    """Every score from its definition: windows of 12 words, a word the mean of its n-grams' and its own entries."""
    rng = random.Random(7)
    table = np.random.default_rng(3).normal(size=toxicity.BUCKETS)
    model = {"table": table, "bias": 0.3, "scale": 2.0, "shift": -0.5}

    def entries(word):
        starts, found = toxicity.words_and_grams(word)
        assert len(starts) == 1
        raw = b" " + toxicity.plain(word) + b" "
        assert sum(len(bucket) for _, bucket in found) == 1 + sum(max(0, len(raw) - k + 1) for k in toxicity.GRAMS)
        return np.concatenate([table[bucket] for _, bucket in found]).mean()

    for n in (1, 5, 11, 12, 13, 25, 80):
        words = [rng.choice(["garden", "Élan", "x1", "idiot", "a", "numbskull", "id1ot"]) for _ in range(n)]
        means = [entries(w) for w in words]
        logit = max(np.mean(means[a : a + 12]) for a in range(0, max(1, n - 6), 6)) + 0.3
        assert toxicity.score_text(" , ".join(words), model) == pytest.approx(1 / (1 + np.exp(-(2.0 * logit - 0.5))), abs=1e-9)
    assert len(set(toxicity.words_and_grams("idiot")[1][0][1]) & set(toxicity.words_and_grams("idiott")[1][0][1])) >= 4


def test_toxicity_held_out(spark):
    from pathlib import Path

    folder = Path("/root/testdata/sf0.1")
    if not folder.exists():
        pytest.skip("no test tables")
    docs, labels = (spark.read.parquet(str(folder / f"{x}.parquet")) for x in ("documents", "labels"))
    rows = toxicity.toxicity_report(docs, labels).filter("held_out").join(labels.filter("toxic is not null"), "doc_id").select("toxic", "predicted").collect()
    caught = sum(r["toxic"] and r["predicted"] for r in rows)
    assert caught >= 0.7 * sum(r["toxic"] for r in rows) and caught >= 0.75 * sum(r["predicted"] for r in rows)


def test_toxicity_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i, "word " * 200) for i in range(400)] + [(None, "idiot"), (None, None)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(400)], "doc_id bigint, quality int, toxic int")
    assert 0 < toxicity.sampled(docs, labels, max_rows=100).count() < 160
    assert 0 < toxicity.sampled(docs, labels, max_bytes=60_000).count() < 110
    assert toxicity.sampled(docs, labels, folds=1, held=9).count() == 400


def test_toxicity_fit_sees_all_windows():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["garden", "Élan", "x1", "idiot", "b,c"]) for _ in range(n)) for n in (2000, 0, 1, 11, 12, 13, 18, 19, 500)]
    sample = toxicity.Sample(texts)
    table = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    want = []
    for d, text in enumerate(texts):
        means = toxicity.word_means(text, table)
        want += [(d, means[a : a + 12].mean() + 0.5) for a in range(0, max(1, len(means) - 6), 6) if len(means)]
    assert sample.doc.tolist() == [d for d, _ in want] and len(want) > 400
    np.testing.assert_allclose(sample.logits(table, 0.5), [x for _, x in want], atol=1e-9)


def test_toxicity_fit_reads_whole_texts():
    text = "x" * 1000 + " " + "ab " * 1_400_000 + "numbskull"
    sample = toxicity.Sample([text])
    table = np.random.default_rng(1).normal(size=toxicity.BUCKETS)
    assert len(text) > 1 << 22 and len(sample.words) == 1_400_002 and len(sample.per) == 3
    assert sample.logits(table, 0.0).max() == pytest.approx(toxicity.toxic_logit(text, table, 0.0))


def test_pieces_lose_no_words():
    text = " ".join(str(i) for i in range(300_000))
    assert "".join(toxicity.slices(text)) == text and len(list(toxicity.slices(text))) > 1
    assert "".join(toxicity.slices("x" * (2 << 20))) == "x" * (2 << 20)


def test_chat(spark):
    talks = [(1, 0, "user", "hi"), (1, 1, "assistant", "a\\b ### x </turn>\n\\e \\h"), (1, 2, "user", None), (1, 3, "assistant", ""), (2, 5, None, "x: y"), (2, 7, "as:sistant", "y"), (3, 0, "assistant", "é" * 900), (None, 0, "system", "s"), (4, 1, "user", "b"), (4, 1, "user", "a")]
    talks += [(9, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)]
    df = spark.createDataFrame(talks, "conv_id bigint, turn bigint, role string, text string")
    want, groups = [], defaultdict(list)
    for c, t, r, x in talks:
        groups[c].append((t, r or "", x or ""))
    for c, g in groups.items():
        g.sort()
        told = "".join(f"{r}\n{x}\n" for _, r, x in g)
        loss = "".join(x for _, r, x in g if r == "assistant")
        want.append((c, len(g), sha(told), len(loss), sha(loss)))
    assert out(chat_format.chat_report(df).drop("formatted_chars")) == sorted(want, key=repr)
    assert chat_format.chat_report(df.limit(0)).count() == 0


def test_reply_tree_branches(spark):
    nodes = [("t", 1, None, "user", "q", 0.0), ("t", 2, 1, "assistant", "bad", 0.1), ("t", 3, 1, "assistant", "good", 0.9), ("t", 4, 3, "user", "more", 0.0), ("t", 5, 3, "user", "less", -0.5), ("t", 6, 6, "user", "loop", 5.0), ("t", 6, 6, "user", "loop", 5.0), ("u", 1, 99, "user", "alone", None)]
    df = spark.createDataFrame(nodes, "tree string, node bigint, parent bigint, role string, text string, score double")
    got = {(r["tree"], r["rank"]): [t["text"] for t in r["turns"]] for r in chat_format.read_back(chat_format.format_reply_trees(df, best=9)).collect()}
    assert got == {("t", 1): ["q", "good", "more"], ("t", 2): ["q", "good", "less"], ("t", 3): ["q", "bad"], ("u", 1): ["alone"]}


def test_labels_of_other_documents_are_not_broadcast(spark):
    """Labels without a document count neither in the sample's share nor in what is broadcast."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(1, 6)] + [(None, "x")], "doc_id bigint, text string")
    labels = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(0).alias("quality"), F.lit(1).alias("toxic"))
    rows = toxicity.sampled(docs, labels, max_rows=100)
    assert sorted(r["doc_id"] for r in rows.collect()) == [i for i in range(1, 6) if zlib.crc32(str(i).encode()) % 5]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan

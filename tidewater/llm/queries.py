"""The registered queries of this subpackage, one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, chat_format, exact_dedup, fingerprints, language_id, merkle, mixing, odd_sketch, simhash, spelling_variants, substring_dedup, token_files, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_chat_format(spark, sf_dir):
    said = "\\### Assistant: </turn> ok"
    one = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.chat_report(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(one))


def op4_simhash(spark, sf_dir):
    return simhash.near_dup_report(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup_report(_table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark, sf_dir):
    return byte_bpe.bpe_report(_table(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    return mixing.mix_report(_table(spark, sf_dir, "documents"))


def op8_language_id(spark, sf_dir):
    return language_id.language_report(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark, sf_dir):
    return substring_dedup.substring_report(_table(spark, sf_dir, "documents"))


def op10_token_files(spark, sf_dir):
    return token_files.token_file_rows(_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark, sf_dir):
    return spelling_variants.variant_report(_table(spark, sf_dir, "documents"))


def op12_merkle(spark, sf_dir):
    return merkle.merkle_report(_table(spark, sf_dir, "documents"))


def op13_odd_sketch(spark, sf_dir):
    return odd_sketch.odd_sketch_report(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_toxicity, op3_chat_format, op4_simhash, op5_exact_dedup, op6_byte_bpe, op7_mixing, op8_language_id, op9_substring_dedup, op10_token_files, op11_spelling_variants, op12_merkle, op13_odd_sketch)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _crc_table() -> str:
    table = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        table.append(n)
    return str(table)


def _crc32(text: str) -> str:
    """The unsigned crc32 of a text of code points below U+0800, in UTF-8."""
    encoded = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN c = '' THEN CAST([] AS BIGINT[]) WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(192 + unicode(c) // 64 AS BIGINT), CAST(128 + unicode(c) % 64 AS BIGINT)] END))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {encoded}), lambda c, b: xor(c >> 8, CAST({_crc_table()}[(xor(c, b) & 255) + 1] AS BIGINT))), CAST(4294967295 AS BIGINT))"


def _merkle_sql(levels: int = 9, branch_levels: int = 3) -> str:
    """Levels written out; enough for 8 ** levels rows of a branch and 8 ** branch_levels branches."""
    part = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join([*map(part, ("doc_id", "source", "lang", "n_chars")), part(text)]) + ")"
    low = "CASE WHEN crc % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    out = f"""
WITH d AS (SELECT *, {_crc32("coalesce(CAST(doc_id AS VARCHAR), '')")} AS crc, coalesce(':' || lang, '') AS branch FROM documents),
l AS (SELECT doc_id, branch, {leaf('text')} AS leaf, {leaf(low)} AS changed FROM d),
a0 AS (SELECT branch, row_number() OVER (PARTITION BY branch ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, doc_id, leaf, changed,
       count(*) OVER (PARTITION BY branch) AS m, leaf AS h FROM l)"""
    def climb(name: str, n: int) -> str:  # noqa: E306
        sql = ""
        for k in range(n):
            sql += f""",
{name}{k + 1} AS (SELECT branch, i // 8 AS i, (m + 7) // 8 AS m, CASE WHEN m = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h,
       list(h ORDER BY i) AS run, m = 1 AS same FROM (SELECT branch, i, m, h FROM {name}{k}) GROUP BY branch, i // 8, m)"""
        return sql
    out += climb("a", levels)  # noqa: E305
    out += f""",
b0 AS (SELECT '' AS branch, branch AS name, row_number() OVER (ORDER BY branch) - 1 AS i, count(*) OVER () AS m, h FROM a{levels})"""
    out += climb("b", branch_levels)
    joins, steps = [], []
    for name, leaf_, n in (("a", "a0", levels), ("b", "b0", branch_levels)):
        for k in range(n):
            joins.append(f"JOIN {name}{k + 1} ON {name}{k + 1}.branch = {leaf_}.branch AND {name}{k + 1}.i = {leaf_}.i // {8 ** (k + 1)}")
            steps.append((f"{name}{k + 1}", f"({leaf_}.i // {8 ** k}) % 8"))
    left = lambda n, p: f"CASE WHEN {n}.same THEN '' ELSE array_to_string({n}.run[1:CAST({p} AS BIGINT)], '') END"
    right = lambda n, p: f"CASE WHEN {n}.same THEN '' ELSE array_to_string({n}.run[CAST({p} AS BIGINT) + 2:8], '') END"
    path = ", ".join(f"{{'l': {left(n, p)}, 'r': {right(n, p)}, 'same': {n}.same}}" for n, p in steps)
    out += f""",
p AS (SELECT a0.doc_id, a0.leaf, a0.changed, b0.h AS subroot, b{branch_levels}.h AS root, [{path}] AS path
      FROM a0 JOIN b0 ON b0.name = a0.branch {' '.join(j for j in joins if j.startswith('JOIN a'))} {' '.join(j for j in joins if j.startswith('JOIN b'))}),"""
    hashed = "changed"
    for k in range(len(steps)):
        out += f"\nf{k} AS (SELECT *, CASE WHEN path[{k + 1}].same THEN {hashed} ELSE sha256(path[{k + 1}].l || {hashed} || path[{k + 1}].r) END AS h{k} FROM {f'f{k - 1}' if k else 'p'}),"
        hashed = f"h{k}"
    return out.rstrip(",") + f"""
SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(path, lambda x: x.l || x.r), '')) AS proof_sha256,
       {hashed} AS folded_root, {hashed} = root AS verified FROM f{len(steps) - 1}"""


ORACLE_SQL = {
    "op3_chat_format": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
marked AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\e') AS shown,
         replace(replace(replace(replace(role, '\', '\\'), '###', '\h'), '</turn>', '\e'), ':', '\c') AS name FROM rows)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(shown) + length(name) + 14) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id""",
    "op5_exact_dedup": f"""
WITH t AS (SELECT doc_id, sha256({_LOWER}) AS h, {_LOWER} AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM t WINDOW g AS (PARTITION BY norm)""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({_LOWER}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY d, run),
hashed AS (SELECT *, {_crc32("d || ':' || run")} AS h FROM counted),
cut AS (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
cutting AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v),
cuts AS (SELECT DISTINCT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS key FROM cutting),
pairs AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cuts a JOIN cuts b USING (key, p) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cuts a JOIN v b ON b.word = a.key
  UNION SELECT b.word, b.n, a.word, a.n FROM cuts a JOIN v b ON b.word = a.key),
best AS (SELECT word, n, count(*) AS n_near, min({{'less': -near_n, 'near': encode(near)}}) AS b FROM pairs GROUP BY word, n),
formed AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 10 * v.n THEN decode(b.near) END AS form,
           CASE WHEN -b.less >= 10 * v.n THEN -b.less END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS last, form AS next FROM formed
         UNION ALL SELECT w.word, f.word, f.form FROM walk w JOIN formed f ON f.word = w.next)
SELECT word, form, last AS root, n, n_near, form_n FROM formed JOIN walk USING (word) WHERE next IS NULL""",
    "op12_merkle": _merkle_sql(),
    "op13_odd_sketch": rf"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array({_LOWER}, '[ 	-
]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS g FROM t),
e AS (SELECT r, len(g) AS n, unnest(g) AS x FROM s),
links AS (SELECT a.r AS a, b.r AS b FROM e a JOIN e b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
walk AS (SELECT a AS r, b AS o FROM links UNION SELECT w.r, l.b FROM walk w JOIN links l ON l.a = w.o),
ids AS (SELECT w.r, min(s.doc_id) AS low FROM walk w JOIN s ON s.r = w.o GROUP BY w.r)
SELECT doc_id, len(g) AS n_shingles, least(doc_id, low) AS component_id, doc_id IS NOT DISTINCT FROM least(doc_id, low) AS kept FROM s LEFT JOIN ids USING (r)""",
}

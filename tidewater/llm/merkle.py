"""A Merkle manifest of a table: every row a leaf, a tree for each branch, and a tree of the branches' roots.

Leaves are numbered without one task holding a branch: digests are sorted by range into files, and a leaf's
number is its row in its file and the rows of the branch in the files before. A level is a DataFrame: node
numbers divided by the fanout, the children of a run as a sorted array, hashed into their parent. Only branches
of several nodes go on, until none is left. Proofs come down the same levels: each level's nodes join their
parents, which hold the siblings, so a join has as many rows as the level has nodes and no key more than
``FANOUT`` of them. Texts do not travel, only digests.

Defined results: a null field is ``-``; null identifiers come first among a branch's leaves, rows of one
identifier in order of their leaf digests, and equal rows are interchangeable; the null branch comes first; the
only row of a table is its own root, with no siblings; a table without rows has no nodes and no root. A null
identifier counts as an empty text where crc32 decides what is tampered with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, crc_fold, stored

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


@dataclass
class Manifest:
    """root: its digest, None without rows. leaves: the rows with at, subroot, and path: the siblings of each level, from the leaf up."""

    root: str | None
    leaves: DataFrame


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def field(value: Column) -> Column:
    """- for null, else the value behind its UTF-8 byte count."""
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def row_digest(*values: Column) -> Column:
    return sha(F.concat(*map(field, values)))


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """The rows with ``at``, counted from 0 within each branch in the given order, and ``nodes``, how many the branch has."""
    by = ["branch", *order, "tie"]  # the tie parts equal rows, so no task has to take all of them
    ranged = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(ranged, "merkle-sorted").select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    # one row for each file and branch in it; a branch's files follow each other in order of their least rows
    runs = placed.groupBy("branch", "file").agg(F.count("*").alias("n"), F.min("row").alias("first"), F.min(F.struct(*by[1:])).alias("least"))
    whole = Window.partitionBy("branch")
    ahead = F.sum("n").over(whole.orderBy("least").rowsBetween(Window.unboundedPreceding, -1))
    runs = runs.select("branch", "file", "first", F.coalesce(ahead, F.lit(0).cast("long")).alias("ahead"), F.sum("n").over(whole).alias("nodes"))
    return placed.join(runs, ["branch", "file"]).withColumn("at", F.col("ahead") + F.col("row") - F.col("first")).drop("file", "row", "first", "ahead", "tie")


def parents(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """branch, at, nodes, digest, children of the level above that of the nodes."""
    place, own = F.pmod("at", F.lit(fanout)), F.floor(F.col("at") / fanout)
    runs = nodes.groupBy("branch", own.alias("at"), F.ceil(F.col("nodes") / fanout).alias("nodes")).agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "digest"))).alias("run"))
    runs = runs.withColumn("children", F.transform("run", lambda x: x["digest"]))
    return runs.select("branch", "at", "nodes", sha(F.array_join("children", "")).alias("digest"), "children")


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """The leaves (branch, at, nodes, digest) and every level above them, up to one node for each branch."""
    found = [leaves]
    while True:
        wide = found[-1].filter("nodes > 1")
        if wide.isEmpty():
            return found
        found.append(stored(parents(wide, fanout), "merkle-level"))


def tops(found: list[DataFrame]) -> DataFrame:
    """branch, digest: what remains of each branch."""
    out = [level.filter("nodes = 1").select("branch", "digest") for level in found]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def with_paths(found: list[DataFrame], above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The leaves with subroot and path; above: branch and path of each branch's root."""
    before = None
    for level in reversed(found):
        out = level.filter("nodes = 1").join(above, "branch").withColumn("subroot", F.col("digest"))
        if before is not None:
            parent = before.select("branch", F.col("at").alias("up"), "children", "subroot", F.col("path").alias("further"))
            rest = level.filter("nodes > 1").withColumn("up", F.floor(F.col("at") / fanout)).join(parent.withColumnRenamed("children", "run"), ["branch", "up"])
            place = F.pmod("at", F.lit(fanout)).cast("int")
            siblings = F.struct(F.array_join(F.slice("run", F.lit(1), place), "").alias("left"), F.array_join(F.slice("run", place + 2, F.lit(fanout)), "").alias("right"))
            rest = rest.withColumn("path", F.concat(F.array(siblings), "further").cast(PATH)).drop("up", "run", "further")
            out = out.unionByName(rest)
        before = out
    return before


def folded(path: Column, digest: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, digest, lambda acc, x: sha(F.concat(x["left"], acc, x["right"])))


def manifest(rows: DataFrame, *order: str, fanout: int = FANOUT) -> Manifest:
    """rows: branch (a string that is not null), digest, the columns of the order, any others."""
    leaves = stored(numbered(rows, *order), "merkle-leaves")
    found = levels(leaves, fanout)
    names = tops(found).select(F.lit("").alias("branch"), F.col("branch").alias("name"), "digest")
    branches = levels(stored(numbered(names, "name"), "merkle-branches"), fanout)
    root = tops(branches).first()
    none = branches[0].sparkSession.range(1).select(F.lit("").alias("branch"), F.array().cast(PATH).alias("path"))
    above = with_paths(branches, none, fanout).select(F.col("name").alias("branch"), "path")
    return Manifest(root and root["digest"], with_paths(found, above, fanout))


def merkle_report(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row; where 3 divides the identifier's crc32, A-Z were lower-cased."""
    values = [F.col(c) for c in FIELDS]
    changed = row_digest(*values[:-1], F.when(crc_fold(F.col("doc_id"), 3) == 0, ascii_lower(F.col("text"))).otherwise(F.col("text")))
    branch = F.coalesce(F.concat(F.lit(":"), "lang"), F.lit(""))  # null first
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), branch.alias("branch"), row_digest(*values).alias("digest"), changed.alias("changed"))
    tree = manifest(rows, "doc_id", "digest", fanout=fanout)
    proof = sha(F.array_join(F.transform("path", lambda x: F.concat(x["left"], x["right"])), ""))
    found = tree.leaves.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(tree.root).cast("string").alias("root"), proof.alias("proof_sha256"), folded(F.col("path"), F.col("changed")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))

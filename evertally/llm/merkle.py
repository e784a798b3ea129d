"""Merkle manifest of a table of documents: a digest per row, a tree per language, one root over the languages.

Leaves of a language ascend by id; every eight consecutive nodes have one parent until one node is left. Nodes of
a level find their siblings with `lag` and `lead` at fixed offsets, masked by their slot in the run of eight and
by the length of the run; the first child of a run hashes the parent. Four levels fit into a window over a block
of 4,096 leaves: nodes of a higher level are the rows whose place divides by its step, so all of them share one
shuffle and one sort. The last node of each block goes on to the next storey, which has 1/4096 of the rows.
No window holds more than a block, whatever the size of a language.

Defined results: a null value is hashed as `-`, an empty one as `0:`; leaves with equal or null ids are ordered
by their digest, null ids first; repeated rows are separate, equal leaves; a null language comes first; a very long
text is one leaf; empty tables give empty results; columns besides the five are ignored. A row without id is
never tampered with.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evertally.llm.ordering import numbered
from evertally.llm.tables import written

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 8, 4
BLOCK = ARITY**LEVELS
PATH = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """A value as it enters a leaf: its length in bytes, a colon, the value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _storey(nodes: DataFrame) -> DataFrame:
    """Four levels over blocks of nodes (tree, place, nodes, digest).

    Adds `level0`.. at the nodes of each level that has siblings to hash with, and `top`, the digest of the block,
    at its first row.
    """
    window = Window.partitionBy("tree", "block").orderBy("place")
    rows = nodes.withColumn("block", F.expr(f"place div {BLOCK}")).withColumn("top", F.col("digest"))
    for level in range(LEVELS):
        step = ARITY**level
        slot = F.expr(f"(place div {step}) % {ARITY}")
        count = F.expr(f"(nodes + {step - 1}) div {step}")
        length = F.least(F.lit(ARITY), count - F.expr(f"place div {step}") + slot)
        left = [F.when(slot >= k, F.lag("top", k * step).over(window)) for k in range(ARITY - 1, 0, -1)]
        right = [F.when(slot + k < length, F.lead("top", k * step).over(window)) for k in range(1, ARITY)]
        siblings = F.struct(F.concat_ws("", *left).alias("left"), F.concat_ws("", *right).alias("right"))
        hashed = (F.col("place") % step == 0) & (count > 1)
        rows = rows.withColumn(f"level{level}", F.when(hashed, siblings))
        parent = F.when(hashed, F.sha2(F.concat("top", f"level{level}.right"), 256)).otherwise(F.col("top"))
        rows = rows.withColumn("top", F.when(F.col("place") % (step * ARITY) == 0, parent))
    return rows


def _paths(storey: DataFrame) -> DataFrame:
    """Adds `path`, the siblings on the way up from each row through its block, lowest level first."""
    up_to_here = Window.partitionBy("tree", "block").orderBy("place")
    up_to_here = up_to_here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = storey.withColumn("path", F.array().cast(PATH))
    for level in reversed(range(LEVELS)):
        above = F.last(F.when(F.col("place") % (ARITY ** (level + 1)) == 0, F.col("path")), ignorenulls=True)
        own = F.when(F.col(f"level{level}").isNotNull(), F.array(f"level{level}")).otherwise(F.array()).cast(PATH)
        rows = rows.withColumn("path", F.concat(own, above.over(up_to_here)))
    return rows


def proofs(nodes: DataFrame, extra: list[str], name: str) -> DataFrame:
    """(tree, place, digest, path, root) and `extra` for the nodes of a written table (tree, place, nodes, digest)."""
    storey = _storey(nodes)
    tops = storey.filter(F.col("place") % BLOCK == 0)
    tops = tops.select(
        "tree",
        F.col("block").alias("place"),
        F.expr(f"(nodes + {BLOCK - 1}) div {BLOCK}").alias("nodes"),
        F.col("top").alias("digest"),
    )
    tops = written(tops, name)
    if (tops.agg(F.max("nodes")).first()[0] or 0) > 1:
        above = proofs(tops, [], name).select("tree", "place", "path", "root")
    else:
        above = tops.select("tree", "place", F.array().cast(PATH).alias("path"), F.col("digest").alias("root"))
    above = above.select(
        F.col("tree").alias("_tree"), F.col("place").alias("_block"), F.col("path").alias("_path"), "root"
    )
    here = F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block"))
    rows = _paths(storey).join(above, here)
    return rows.select("tree", "place", "digest", *extra, F.concat("path", "_path").alias("path"), "root")


def _counted(rows: DataFrame, place: str) -> DataFrame:
    """Globally numbered rows as nodes of their trees: places from 0 in each, and how many there are."""
    trees = rows.groupBy("tree").agg(F.min(place).alias("_first"), F.count("*").alias("nodes"))
    trees = trees.withColumnRenamed("tree", "_tree")
    rows = rows.join(trees, F.col("tree").eqNullSafe(F.col("_tree")))
    return rows.withColumn("place", F.col(place) - F.col("_first")).drop(place, "_first", "_tree")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of its path."""
    return F.aggregate(path, leaf, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]), 256))


def proof_digest(path: Column) -> Column:
    texts = F.transform(path, lambda level: F.concat(level["left"], level["right"]))
    return F.sha2(F.array_join(texts, ""), 256)


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """Per row: doc_id, lang, leaf, other_leaf, place in its language, path to the root, subroot, root.

    `tampered` is what may have become of `text`; where it is not null, `other_leaf` is the leaf that it gives.
    """
    values = [F.col(name) for name in FIELDS]
    other = F.lit(None).cast("string")
    if tampered is not None:
        other = F.when(tampered.isNotNull(), leaf_digest([*values[:-1], tampered]))
    leaves = docs.select(
        "doc_id",
        F.col("lang").alias("tree"),
        leaf_digest(values).alias("digest"),
        other.alias("other_leaf"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col(name) for name in ("tree", "doc_id", "digest", "_row")]
    leaves = _counted(numbered(written(leaves, "leaves"), order, "sorted_leaves", "_at"), "_at")
    leaves = written(leaves.drop("_row"), "nodes")
    rows = proofs(leaves, ["doc_id", "other_leaf"], "tops").withColumnRenamed("root", "subroot")

    # one leaf of each language knows its subroot: they are the leaves of the last tree
    subroots = written(rows.filter("place = 0").select("tree", "subroot"), "subroots")
    named = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("lang"), F.col("subroot").alias("digest"))
    named = numbered(named, [F.col("lang"), F.col("digest")], "sorted_subroots", "_at")
    named = written(_counted(named, "_at"), "subroot_nodes")
    last = proofs(named, ["lang"], "roots").select("lang", F.col("path").alias("_last"), "root")
    rows = rows.join(last, F.col("tree").eqNullSafe(F.col("lang")))
    return rows.select(
        "doc_id", F.col("tree").alias("lang"), F.col("digest").alias("leaf"), "other_leaf", "place",
        F.concat("path", "_last").alias("path"), "subroot", "root",
    )


def verified_manifest(docs: DataFrame) -> DataFrame:
    """The manifest as digests, folded again after a third of the rows had their letters A-Z lowered."""
    a_third = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    rows = manifest(docs, F.when(a_third, lowered(F.col("text"))))
    rows = rows.withColumn("folded_root", folded(F.coalesce("other_leaf", "leaf"), F.col("path")))
    return rows.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )

"""Merkle manifest of a dataset: leaves, trees, proofs and their verification as joins.

At every level each node finds the other nodes of its run by an equijoin with their computed indices (XOR 1 for binary trees, slot
offsets otherwise); rows of slot zero emit the parents.  What stands beside a node is kept, so the proof of every row comes
down from the root by joins with the parents.  Digests are hashed as hexadecimal text and kept as bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.session import materialise

ARITY = 8
#: Columns of ``documents`` that a leaf covers, in order.
COVERED = ("doc_id", "source", "lang", "n_chars", "text")


def shown(digest: Column) -> Column:
    """A digest, or several in a row, as lowercase hexadecimal text."""
    return F.lower(F.hex(digest))


def hashed(text: Column) -> Column:
    """SHA-256 as bytes."""
    return F.unhex(F.sha2(text, 256))


def leaf_of(columns: Sequence[Column]) -> Column:
    """Digest of a row's values, each ``-`` if NULL, else its length in UTF-8 bytes, a colon and the value as text."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return hashed(F.concat(*parts))


def _ranked(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``place`` (gapless from 0 in each ``tree``, by ``order``) and ``n`` (rows of the tree).

    Rows are range-partitioned by tree and order, equal ones too (by ``__tie``), and numbered within their partition; the number
    of rows of each tree in each partition then gives the offsets.  No tree is gathered in one task.
    """
    by = ["tree", *order, "__tie"]
    numbered = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id())
    numbered = materialise(numbered.drop("__tie"), "merkle-ranks").withColumn("__part", F.shiftright("__at", 33))
    parts = numbered.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    whole, before = Window.partitionBy("tree"), Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("tree", "__part", (F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__rows").over(whole).alias("n"))
    return numbered.join(parts, ["tree", "__part"]).withColumn("place", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")


def beside(nodes: DataFrame, arity: int) -> DataFrame:
    """``tree``, ``place``, ``n``, ``digest`` and the joined digests of the run ``before`` and ``after`` each node of a level."""
    place = F.col("place")
    if arity == 2:
        run = F.array(place, place.bitwiseXOR(F.lit(1).cast("long")))
    else:
        slot = place % arity
        run = F.transform(F.sequence(F.lit(0), F.lit(arity - 1)), lambda offset: place - slot + (slot + offset) % arity)
    wanted = nodes.select("tree", "place", "n", F.explode(run).alias("sibling")).where("sibling < n")
    found = nodes.select("tree", F.col("place").alias("sibling"), "digest")
    met = wanted.join(found, ["tree", "sibling"]).groupBy("tree", "place", "n").agg(F.sort_array(F.collect_list(F.struct("sibling", "digest"))).alias("run"))

    def joined(keep) -> Column:
        return F.unhex(F.array_join(F.transform(F.filter("run", keep), lambda one: F.hex(one["digest"])), ""))

    own = F.filter("run", lambda one: one["sibling"] == place)[0]["digest"]
    return met.select("tree", "place", "n", own.alias("digest"), joined(lambda one: one["sibling"] < place).alias("before"), joined(lambda one: one["sibling"] > place).alias("after"))


def _parents(level: DataFrame, arity: int) -> DataFrame:
    """Nodes of the next level, from the rows of slot zero."""
    whole = F.concat("before", "digest", "after")
    return level.where(F.col("place") % arity == 0).select(
        "tree", F.expr(f"place div {arity}").alias("place"), F.expr(f"(n + {arity - 1}) div {arity}").alias("n"), hashed(shown(whole)).alias("digest")
    )


def _levels(nodes: DataFrame, arity: int) -> tuple[list[DataFrame], DataFrame]:
    """What stands beside the nodes of each level, leaves first, and the roots (``tree``, ``level``, ``digest``) of all trees."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 1, []
    roots = nodes.where("n = 1").select("tree", F.lit(0).alias("level"), "digest")
    while most > 1:
        levels.append(materialise(beside(nodes.where("n > 1"), arity), "merkle-level"))
        nodes, most = _parents(levels[-1], arity), -(-most // arity)
        roots = roots.union(nodes.where("n = 1").select("tree", F.lit(len(levels)).alias("level"), "digest"))
    return levels, roots


def _step() -> Column:
    return F.array(F.struct("before", "after"))


def _down(levels: list[DataFrame], roots: DataFrame, arity: int, last: int) -> DataFrame:
    """``tree``, ``place``, ``path`` and the columns of ``roots`` beyond ``tree``, ``level`` and ``path`` of all nodes of level ``last``.

    ``roots`` names for each tree the level of its root and the path from there up.
    """
    carried = [c for c in roots.columns if c not in ("tree", "level")]
    at = lambda level: roots.where(F.col("level") == level).select("tree", F.lit(0).cast("long").alias("place"), *carried)
    above = at(len(levels))
    for k in range(len(levels) - 1, last - 1, -1):
        here = levels[k].select("tree", "place", F.expr(f"place div {arity}").alias("up"), _step().alias("step"))
        here = here.join(above.withColumnRenamed("place", "up"), ["tree", "up"])
        above = here.select("tree", "place", F.concat("step", "path").alias("path"), *[c for c in carried if c != "path"]).unionByName(at(k))
    return above


def manifest(docs: DataFrame, columns: Sequence[str] = COVERED, group: str = "lang", order: str = "doc_id", arity: int = ARITY, keep: dict[str, Column] | None = None) -> DataFrame:
    """The ``keep`` columns (the order column, if none are named), ``leaf``, ``subroot``, ``root`` and ``path`` of every row.

    Each value of ``group`` has a tree over its rows by ``order`` (NULL first, equal ones by leaf): while several nodes remain,
    each run of ``arity`` becomes one, the last run with what is left.  The trees' roots, by the group's text (NULL first), are
    the leaves of the tree over all.  ``path`` holds, from the leaf to the root, what is joined ``before`` and ``after`` the
    node that is hashed.  Repeated rows are leaves each; no rows give none.  Digests are bytes.
    """
    if arity < 2:
        raise ValueError("a run has two nodes at least")
    kept = {order: F.col(order)} if keep is None else keep
    tree = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    rows = docs.select(tree.alias("tree"), F.col(order).alias("__order"), leaf_of([F.col(c) for c in columns]).alias("digest"), F.struct(*[c.alias(n) for n, c in kept.items()]).alias("kept"))
    rows = materialise(rows.withColumn("__tie", F.xxhash64(F.monotonically_increasing_id())), "merkle-leaves")
    ranked = materialise(_ranked(rows, ["__order", "digest"]).select("tree", "place", "n", "digest", "kept"), "merkle-ranked")
    levels, subroots = _levels(ranked.drop("kept"), arity)
    # The tree over the trees.
    subroots = materialise(subroots, "merkle-subroots")
    given = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("of"), "level", "digest", F.lit(0).cast("long").alias("__tie"))
    tops = materialise(_ranked(given, ["of"]), "merkle-tops")
    top_levels, root = _levels(tops.select("tree", "place", "n", "digest"), arity)
    nothing = F.array().cast("array<struct<before:binary,after:binary>>")
    over = _down(top_levels, root.select("tree", "level", nothing.alias("path"), F.col("digest").alias("root")), arity, 0)
    over = tops.join(over, ["tree", "place"]).select(F.col("of").alias("tree"), "level", "path", F.col("digest").alias("subroot"), "root")
    over = materialise(over, "merkle-over")
    # Down again: every row meets what stands beside it, then the path of its parent.
    carried = ("path", "subroot", "root")
    lone = ranked.where("n = 1").join(over.where("level = 0"), "tree").select("kept", "digest", *carried)
    if levels:
        up = _down(levels, over, arity, 1).withColumnRenamed("place", "up")
        rows = ranked.where("n > 1").select("tree", "place", "kept").join(levels[0], ["tree", "place"])
        rows = rows.withColumn("up", F.expr(f"place div {arity}")).withColumn("step", _step()).join(up, ["tree", "up"])
        lone = rows.select("kept", "digest", F.concat("step", "path").alias("path"), "subroot", "root").unionByName(lone)
    return lone.select("kept.*", F.col("digest").alias("leaf"), "subroot", "root", "path")


def proof(path: Column) -> Column:
    """All siblings on a path as text, level by level, left to right."""
    return F.array_join(F.transform(path, lambda step: shown(F.concat(step["before"], step["after"]))), "")


def folded(leaf: Column, path: Column) -> Column:
    """The root as text that a leaf has by its path."""
    return F.aggregate(path, shown(leaf), lambda own, step: F.sha2(F.concat(shown(step["before"]), own, shown(step["after"])), 256))


def verified(manifest_: DataFrame, leaf: Column) -> DataFrame:
    """``manifest_`` with ``folded_root`` of another ``leaf`` in place of each row's own, and whether that is the ``root``."""
    return manifest_.withColumn("folded_root", folded(leaf, F.col("path"))).withColumn("verified", F.col("folded_root") == shown(F.col("root")))


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case, all else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def digests(docs: DataFrame, arity: int = ARITY) -> DataFrame:
    """Leaf, roots and proof of every document, and the check of documents of which every third (by CRC-32 of the id) has its
    text in lower case."""
    changed = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 0, lowered(F.col("text"))).otherwise(F.col("text"))
    now = leaf_of([changed if c == "text" else F.col(c) for c in COVERED])
    held = manifest(docs, arity=arity, keep={"doc_id": F.col("doc_id"), "now": now})
    checked = verified(held, F.col("now"))
    return checked.select(
        "doc_id", *[shown(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")], F.sha2(proof(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified"
    )

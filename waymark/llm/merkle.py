"""Merkle manifest of a dataset: hash trees of ordered leaves, one for each group and one over the groups.

A leaf is the hash of a row's columns. The leaves of a group stand in the order of a key;
every `arity` consecutive nodes (the last run may be shorter, even a single one) become one
node, until one remains: the group's subroot. The subroots, ordered by group (null first,
then by the bytes in UTF-8), give the root in the same way. All of it is column expressions:
nodes are gathered into blocks of arity**depth consecutive ones, each an ordered array that
collapses level by level with sequence, transform, slice and aggregate; the blocks' roots are
the nodes of the next round. A leaf's proof is made of the levels of its blocks, from above
down, so no tree is ever in one place: a task holds one block.

Places in a group come from ranges of the whole order and the counts before them, so a group
of any size, and one key of many rows, is spread over all ranges. Tables on the way hold
hashes and keys, and no texts; they lie in the shared folder. `dropped` deletes them once
the manifest has been written.

Null columns of a row are hashed as a mark that no value has, a null group is a group, a null
key comes first, rows of one key go by their hash. Equal rows have equal leaves and a place
each. A very long text is only hashed where it stands. An empty table gives no rows. Columns of
the input that aren't named are left out, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ._store import dropped, quoted, written

#: Nodes that become one.
ARITY = 2
#: Levels of a block: 1,024 leaves.
DEPTH = 10


def digest(*parts: Column) -> Column:
    """The hash of the parts' texts, one behind the other, as lowercase hex."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaf_of(*columns: Column) -> Column:
    """The hash of a row's values, each as its length in bytes, a colon and itself, or a dash if it is null."""
    parts = []
    for c in columns:
        text = c.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return digest(*parts)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, step: digest(step["left"], node, step["right"]))


def path_digest(path: Column) -> Column:
    """The hash of all siblings of a path, from the leaf to the root, each level's from left to right."""
    return digest(F.array_join(F.transform(path, lambda step: F.concat(step["left"], step["right"])), ""))


def manifest(rows: DataFrame, leaf: Column, group: str, key: str, carry: dict[str, Column] | None = None, arity: int = ARITY, depth: int = DEPTH) -> tuple[DataFrame, list[DataFrame]]:
    """A row for each row: group, key, the carried columns, leaf, subroot, root, and path; and the tables that it reads.

    path: for each level, what stands left and right of the node in its run, as one text each.
    """
    carry = carry or {}
    own = ["group", "key", *carry, "leaf", "subroot", "root", "path"]
    if len({c.lower() for c in own}) < len(own):
        raise ValueError(f"columns would share a name: {own}")
    # a null group is '', others have a mark, so the order of groups holds
    tagged = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))
    item = F.struct(F.col(f"`{group}`").alias("group"), F.col(f"`{key}`").alias("key"), *[c.alias(n) for n, c in carry.items()])
    leaves = written(rows.select(tagged.alias("tree"), item.alias("item"), leaf.alias("node")), "leaves")
    rounds, spent = _trees(leaves, ["item.key", "node"], arity, depth)
    tops = rounds[-1].select(F.col("tree").alias("item"), F.lit("").alias("tree"), F.element_at(F.element_at("levels", -1), 1).alias("node"))
    forest, more = _trees(tops, ["item", "node"], arity, depth)
    # from the root down: a block's path is that of its node in the round above
    top = forest[-1].select("tree", "block", F.element_at(F.element_at("levels", -1), 1).alias("root"), _nothing().alias("above"))
    for level, blocks in enumerate(reversed(forest)):
        top = _nodes(blocks, top, ["root"], arity, depth)
        if level + 1 < len(forest):
            top = top.select("tree", F.col("at").alias("block"), "root", F.col("path").alias("above"))
    # the nodes of the forest are the only blocks of the groups' last round
    top = top.select(F.col("item").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("node").alias("subroot"), "root", F.col("path").alias("above"))
    for level, blocks in enumerate(reversed(rounds)):
        top = _nodes(blocks, top, ["subroot", "root"], arity, depth)
        if level + 1 < len(rounds):
            top = top.select("tree", F.col("at").alias("block"), "subroot", "root", F.col("path").alias("above"))
    out = top.select("item.group", "item.key", *[F.col(f"item.`{n}`") for n in carry], F.col("node").alias("leaf"), "subroot", "root", "path")
    return out, [leaves, *spent, *more]


def _nothing() -> Column:
    return F.expr("cast(array() as array<struct<left:string,right:string>>)")


def _placed(nodes: DataFrame, order: list[str]) -> tuple[DataFrame, list[DataFrame]]:
    """nodes with at, the place in its tree, and n, the tree's nodes; and what was written for it.

    The range's own number and a row's place in it are kept with the row, so the second look
    at them can't differ; the last part of the order makes equal rows distinct.
    """
    ranges = nodes.withColumn("each", F.monotonically_increasing_id())
    by = ["tree", *order, "each"]
    dealt = ranges.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("each", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("range", F.shiftright("each", 33)), "placed")
    counts = dealt.groupBy("tree", "range").agg(F.min("each").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = W.partitionBy("tree")
    before = F.coalesce(F.sum("rows").over(tree.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = written(counts.select("tree", "range", (before - F.col("first")).alias("shift"), F.sum("rows").over(tree).alias("n")), "ranges")
    out = dealt.join(begins, ["tree", "range"]).withColumn("at", F.col("each") + F.col("shift"))
    return out.drop("range", "each", "shift"), [dealt, begins]


def _trees(nodes: DataFrame, order: list[str], arity: int, depth: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """The rounds of blocks of every tree, from the leaves up, and all that was written.

    A block: tree, block (its place), n (the nodes of the tree in this round), items
    and levels, of which the first holds the block's nodes and the last one node.
    """
    placed, spent = _placed(nodes, order)
    size = arity**depth
    rounds = []
    while True:
        member = ["at", "node"] if rounds else ["at", "node", "item"]
        gathered = placed.groupBy("tree", F.floor(F.col("at") / size).cast("long").alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct(*member))).alias("members"))
        items = [] if rounds else [F.col("members.item").alias("items")]
        blocks = written(gathered.select("tree", "block", "n", *items, _levels(F.col("members.node"), F.col("n"), arity, depth).alias("levels")), "blocks")
        rounds.append(blocks)
        most = blocks.agg(F.max("n")).first()[0]
        if (most or 0) <= size:
            return rounds, [*spent, *rounds]
        placed = blocks.select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("node"))


def _levels(nodes: Column, n: Column, arity: int, depth: int) -> Column:
    """All levels of a block: up to `depth` more, as many as a tree of n nodes needs."""
    run = lambda level: F.transform(F.sequence(F.lit(0), F.floor((F.size(level) - 1) / arity).cast("int")), lambda i: digest(F.array_join(F.slice(level, i * arity + 1, arity), "")))
    steps = F.filter(F.sequence(F.lit(0), F.lit(depth - 1)), lambda i: F.pow(F.lit(float(arity)), i) < n)
    return F.aggregate(steps, F.array(nodes), lambda levels, _: F.concat(levels, F.array(run(F.element_at(levels, -1)))))


def _nodes(blocks: DataFrame, above: DataFrame, kept: list[str], arity: int, depth: int) -> DataFrame:
    """A row for each node of the blocks: tree, at, node, path, the kept columns, and item if the blocks have any.

    above: tree, block, the kept columns and above, the path of the block's last node.
    """
    size = F.size(F.element_at("levels", 1))
    step = lambda i, k: _step(F.element_at("levels", k + 1), F.floor(i / F.pow(F.lit(float(arity)), k)).cast("int"), arity)
    # the last level is one node, which has no run of its own
    path = lambda i: F.transform(F.filter(F.sequence(F.lit(0), F.size("levels") - 1), lambda k: k + 1 < F.size("levels")), lambda k: step(i, k))
    has_items = "items" in blocks.columns
    one = lambda i: F.struct(i.alias("i"), F.element_at(F.element_at("levels", 1), i + 1).alias("node"), path(i).alias("local"), *([F.element_at("items", i + 1).alias("item")] if has_items else []))
    rows = blocks.join(above, ["tree", "block"])
    rows = rows.select("tree", "block", *kept, "above", F.explode(F.transform(F.sequence(F.lit(0), size - 1), one)).alias("one"))
    items = [F.col("one.item").alias("item")] if has_items else []
    return rows.select("tree", (F.col("block") * arity**depth + F.col("one.i")).alias("at"), F.col("one.node").alias("node"), *kept, F.concat("one.local", "above").alias("path"), *items)


def _step(level: Column, at: Column, arity: int) -> Column:
    """What stands left and right of a node in its run."""
    first = (F.floor(at / arity) * arity).cast("int")
    left = F.slice(level, first + 1, at - first)
    right = F.slice(level, at + 2, first + arity - 1 - at)
    return F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right"))


def digests(docs: DataFrame) -> DataFrame:
    """The manifest of documents by lang, held against rows of which some were tampered with.

    doc_id, leaf, subroot, root, proof_sha256 (the hash of the path), folded_root and verified: where
    7 divides crc32(doc_id), the row's n_chars was raised by one before its leaf was made again.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    leaf = leaf_of(*quoted(columns))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = F.when(hit, leaf_of(*[F.col(c) + 1 if c == "n_chars" else F.col(c) for c in columns]))
    proofs, spent = manifest(docs, leaf, "lang", "doc_id", {"changed": changed})
    root = folded(F.coalesce("changed", "leaf"), F.col("path"))
    found = proofs.select(F.col("key").alias("doc_id"), "leaf", "subroot", "root", path_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    out = written(found, "manifest")
    dropped(*spent)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))

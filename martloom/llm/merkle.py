"""Merkle manifest of a dataset: one root over all rows, a proof per row, versions by path copying.

Rows are leaves of one tree per group (`tree`); the roots of those trees are the leaves of a
last tree. While more than one node remains, each two consecutive nodes, or a last one alone,
become the hash of their hex digests.

A tree is held in aligned blocks of 2**levels nodes. The nodes of a block are made in one
task, whatever the size of the tree, and its root is one node of the next round of blocks,
so n leaves take log2(n) / levels rounds and each round is 2**levels times smaller. What a
node meets on its way up within its block is its path; the paths of all rounds, put together
by joins on the block, lead from a block of leaves to the root of everything.

Each changed leaf makes a version of the tree. A version shares every node with the base but
the ancestors of its leaf, which it copies: those within the block of leaves first, then, from
the root of that block, those of the distributed rounds, along the path that was joined to it.
Leaves without a change all share the base version, whose block roots are followed up the
same way.

Defined results: a null group is a tree of its own, before all others; leaves are ordered by
id, null ids first, rows with the same id by their digests; a null field is `-`; a change to a
row whose changed field is null is none; a table without rows has no trees and no result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martloom.llm.frames import column, map_batches
from martloom.llm.ranks import ranked
from martloom.session import cut

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LEVELS = 10


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Block:
    """The base nodes of an aligned block, and versions that share them."""

    def __init__(self, nodes: list[str], levels: int | None) -> None:
        """`levels`: as many as every block of the tree has; None for the only block of a tree."""
        self.levels = [nodes]
        while len(self.levels) <= levels if levels is not None else len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])

    @property
    def root(self) -> str:
        return self.levels[-1][0]

    def path(self, i: int) -> str:
        """What a node meets on its way up: `<` and a left sibling, `>` and a right one, `.` for none."""
        steps = []
        for nodes in self.levels[:-1]:
            steps.append("<" + nodes[i - 1] if i % 2 else ">" + nodes[i + 1] if i + 1 < len(nodes) else ".")
            i //= 2
        return "".join(steps)

    def version(self, i: int, node: str) -> list[tuple[int, int, str]]:
        """(level, index, digest) of the nodes copied for a new node at `i`; all others are the base's."""
        copied = [(0, i, node)]
        for level, nodes in enumerate(self.levels[:-1]):
            run = nodes[i - 1] + node if i % 2 else node + "".join(nodes[i + 1 : i + 2])
            node, i = digest(run), i // 2
            copied.append((level + 1, i, node))
        return copied


def steps(path: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(path):
        size = 1 if path[at] == "." else 65
        yield path[at], path[at + 1 : at + size]
        at += size


def climbed(node: str, path: str) -> str:
    """The copies of the upper ancestors, one after another; the last is the root of the version."""
    for side, sibling in steps(path):
        node = digest(sibling, node) if side == "<" else digest(node, sibling)
    return node


def siblings(path: str) -> str:
    return "".join(sibling for _, sibling in steps(path))


def leaf_digest(fields: list[Column]) -> Column:
    """sha256 of each field's UTF-8 byte count, `:` and value, or `-` where it is null."""
    parts = []
    for field in fields:
        text = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def leaves(
    docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id",
    changes: dict[str, Column] | None = None, where: Column | None = None,
) -> DataFrame:
    """(tree, id, leaf, changed): a digest per row, and the one after `changes` where they apply."""
    own = {c: column(docs, c) for c in fields}
    changed = F.lit(None).cast("string")
    if changes:
        new = [changes.get(c, own[c]) for c in fields]
        real = reduce(lambda a, b: a | b, [~changes[c].eqNullSafe(own[c]) for c in changes])
        changed = F.when(real & (F.lit(True) if where is None else where), leaf_digest(new))
    # The mark before the name keeps the null group apart from, and before, any other.
    name = F.coalesce(F.concat(F.lit("="), column(docs, tree).cast("string")), F.lit(""))
    return docs.select(
        name.alias("tree"), column(docs, order).cast("bigint").alias("id"),
        leaf_digest(list(own.values())).alias("leaf"), changed.alias("changed"),
    )


@dataclass(frozen=True)
class Manifest:
    """`blocks` (tree, block, levels, nodes) hold the leaves in order, `paths` (tree, block, path,
    subroot, root) what the root of each block meets on its way to the root of everything."""

    blocks: DataFrame
    paths: DataFrame


def _blocked(nodes: DataFrame, values: list[str], levels: int) -> DataFrame:
    """(tree, block, levels, nodes): at most 2**levels consecutive nodes a row, written.

    `levels` is null for the only block of a tree, which ends where one node remains.
    """
    sizes = nodes.groupBy("tree").agg(F.max("pos").alias("last"))
    block = F.shiftright("pos", levels)
    grouped = nodes.groupBy("tree", block.alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("pos", *values))).alias("nodes")
    )
    high = F.when(F.shiftright("last", levels) > 0, F.lit(levels))
    return cut(grouped.join(cut(sizes, "sizes"), "tree").select("tree", "block", high.alias("levels"), "nodes"), "blocks")


def _of(batch: pa.RecordBatch, field: str) -> list[list]:
    """One list a row from a field of the rows' nodes."""
    nodes = batch.column("nodes")
    flat, ends = nodes.flatten().field(field).to_pylist(), nodes.offsets.to_pylist()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends, ends[1:], strict=False)]


def _made(batch: pa.RecordBatch) -> list[Block]:
    return [Block(n, levels) for n, levels in zip(_of(batch, "leaf"), batch.column("levels").to_pylist(), strict=True)]


def _roots(blocks: DataFrame) -> DataFrame:
    """(tree, pos, leaf): the root of each block as a node of the next round."""

    def roots(batch: pa.RecordBatch) -> dict:
        return {"tree": batch.column("tree"), "pos": batch.column("block"), "leaf": [b.root for b in _made(batch)]}

    return cut(map_batches(blocks, "tree string, pos bigint, leaf string", roots), "roots")


def _paths(blocks: DataFrame) -> DataFrame:
    """(tree, pos, up): the path of each node of a round within its block."""

    def paths(batch: pa.RecordBatch) -> dict:
        out = {"tree": [], "pos": [], "up": []}
        for tree, pos, made in zip(batch.column("tree").to_pylist(), _of(batch, "pos"), _made(batch), strict=True):
            out["tree"] += [tree] * len(pos)
            out["pos"] += pos
            out["up"] += [made.path(i) for i in range(len(pos))]
        return out

    return map_batches(blocks, "tree string, pos bigint, up string", paths)


def _climb(nodes: DataFrame, levels: int) -> tuple[DataFrame, DataFrame]:
    """(tree, pos, path) for every node of `nodes` (tree, pos, leaf), and (tree, leaf): the roots of the trees."""
    rounds, now = [], nodes
    while now.where("pos > 0").limit(1).count():
        blocks = _blocked(now, ["leaf"], levels)
        rounds.append(_paths(blocks))
        now = _roots(blocks)
    path = None
    for up in reversed(rounds):
        if path is None:
            path = up.withColumnRenamed("up", "path")
            continue
        above = path.select("tree", F.col("pos").alias("above"), "path")
        path = up.withColumn("above", F.shiftright("pos", levels)).join(above, ["tree", "above"])
        path = cut(path.select("tree", "pos", F.concat("up", "path").alias("path")), "paths")
    if path is None:
        path = nodes.select("tree", "pos", F.lit("").alias("path"))
    return path, now.select("tree", "leaf")


def manifest(leaves: DataFrame, levels: int = LEVELS) -> Manifest:
    """The trees over `leaves` (tree, id, leaf, changed)."""
    placed = ranked(cut(leaves, "leaves"), ["tree"], ["id", "leaf"])
    blocks = _blocked(placed, ["id", "leaf", "changed"], levels)
    path, subroots = _climb(_roots(blocks), levels)
    subroots = cut(subroots, "subroots")
    trees = ranked(subroots, [], ["tree"]).select(F.lit("").alias("tree"), "pos", "leaf", F.col("tree").alias("of"))
    trees = cut(trees, "trees")
    top, root = _climb(trees.drop("of"), levels)
    ends = trees.join(top, ["tree", "pos"]).join(root.select("tree", F.col("leaf").alias("root")), "tree")
    ends = cut(ends.select(F.col("of").alias("tree"), F.col("leaf").alias("subroot"), F.col("path").alias("on"), "root"), "ends")
    paths = path.join(ends, "tree").select(
        "tree", F.col("pos").alias("block"), F.concat("path", "on").alias("path"), "subroot", "root"
    )
    return Manifest(blocks, cut(paths, "paths"))


PROVED = (
    "id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
)


def proved(made: Manifest) -> DataFrame:
    """Each leaf with the hash of its proof and the root of its version (`folded_root`)."""

    def prove(batch: pa.RecordBatch) -> dict:
        out = {name.split(" ")[0]: [] for name in PROVED.split(", ")}
        rows = zip(
            _of(batch, "id"), _made(batch), _of(batch, "changed"),
            *[batch.column(c).to_pylist() for c in ("path", "subroot", "root")], strict=True,
        )
        for ids, base, changed, path, subroot, root in rows:
            met = siblings(path)
            shared = climbed(base.root, path)
            folded = [
                shared if new is None else climbed(base.version(i, new)[-1][2], path) for i, new in enumerate(changed)
            ]
            out["id"] += ids
            out["leaf"] += base.levels[0]
            out["subroot"] += [subroot] * len(ids)
            out["root"] += [root] * len(ids)
            out["proof_sha256"] += [digest(siblings(base.path(i)), met) for i in range(len(ids))]
            out["folded_root"] += folded
            out["verified"] += [x == root for x in folded]
        return out

    return map_batches(made.blocks.join(made.paths, ["tree", "block"]), PROVED, prove)

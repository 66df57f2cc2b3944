"""A Merkle manifest of a dataset, in which parents keep hash states before each child.

Every row is a leaf: the SHA-256 of its fields, each with its length. The leaves of one
value of ``by`` ascend by key and make a tree; runs of FAN nodes become a parent, the hash
of their hex digests in order, until one node is left, the subroot. Subroots, in order of
``by``, make the last tree, and its root stands for the dataset.

Rows are numbered by a range sort that moves digests only, so one value with most rows
spreads over all tasks. SPAN = FAN ** LEVELS consecutive nodes make a group, the work of one
task. The groups' tops are nodes of the next stage, a SPAN-th of the rows, and each stage
does the same; on the way down each node gets the siblings that lie above its group.
A task folds its group's leaves: a parent keeps a copy of its hash state before each child
slot, and a changed child resumes the state of its slot with the replacement and the
siblings to its right only. Above the group, all leaves share one state a level.

Defined results: a null ``by`` is a value of its own and the first one; null keys come
before others. Rows of one key go by leaf digest; repeated rows are leaves each. A null
field is ``-``. A null doc_id is not tampered with. An empty table has no rows, and no root.
Columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions.text import lower_ascii
from textloom.skew import join_counted
from textloom.storage import materialize, read_table

FAN, LEVELS = 8, 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf(*values: Column) -> Column:
    """The digest of some values in order: ``-`` for a null, else UTF-8 bytes, a colon and the value."""

    def said(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(said, values)), 256)


def height(size: int, fan: int = FAN) -> int:
    """Levels above ``size`` nodes."""
    levels = 0
    while size > 1:
        size, levels = -(-size // fan), levels + 1
    return levels


class Parent:
    """A run of children, given as hex digests, and the hash states before each of them."""

    def __init__(self, children: list[bytes]):
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()
        self.right = [b"".join(children[n + 1 :]) for n in range(len(children))]
        self.siblings = [b"".join(children[:n]) + self.right[n] for n in range(len(children))]

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in a slot."""
        return resumed(self.states[slot], child, self.right[slot])


def resumed(state, child: bytes, right: bytes) -> bytes:
    """The digest of a hash state, which is left as it is, after a child and what is right of it."""
    state = state.copy()
    state.update(child + right)
    return state.hexdigest().encode()


def grown(nodes: list[bytes], levels: int, fan: int = FAN) -> list[list[Parent]]:
    """The parents above some consecutive nodes, level by level."""
    out = []
    for _ in range(levels):
        out.append([Parent(nodes[i : i + fan]) for i in range(0, len(nodes), fan)])
        nodes = [p.digest for p in out[-1]]
    return out


def _top(nodes: list[bytes], levels: int, fan: int) -> bytes:
    """The one node that is left after so many levels."""
    for _ in range(levels):
        nodes = [hashlib.sha256(b"".join(nodes[i : i + fan])).hexdigest().encode() for i in range(0, len(nodes), fan)]
    return nodes[0]


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with ``idx``, their place from 0 on within their tree, and ``size``, the tree's rows. Needs a column tree.

    Places come from a range sort and from counts of its partitions, so no tree has to
    be in one task. Rows alike in every column are told apart by a number, so they can be split, too.
    """
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    by = [F.asc("tree"), *map(F.asc_nulls_first, order), F.asc("salt")]
    ranged = salted.repartitionByRange(*by).sortWithinPartitions(*by).drop("salt")
    placed = materialize(ranged.withColumn("pos", F.monotonically_increasing_id()).withColumn("part", F.shiftright("pos", 33)), "sorted-leaves")
    runs = materialize(placed.groupBy("tree", "part").agg(F.min("pos").alias("first"), F.count(F.lit(1)).alias("n")), "leaf-runs")
    before = F.sum("n").over(Window.partitionBy("tree").orderBy("part")) - F.col("n")
    shifts = runs.select("tree", "part", "n", (before - F.col("first")).alias("shift"), F.sum("n").over(Window.partitionBy("tree")).alias("size"))
    met = join_counted(placed, shifts, ["tree", "part"], "n", runs.agg(F.sum("n")).first()[0] or 0)
    return met.select(*rows.columns, (F.col("pos") + F.col("shift")).alias("idx"), "size")


def grouped(nodes: DataFrame, span: int, *columns: str) -> DataFrame:
    """tree, size, grp, nodes: up to ``span`` consecutive nodes a row, as structs of idx and ``columns``."""
    return nodes.groupBy("tree", "size", F.floor(F.col("idx") / span).alias("grp")).agg(F.array_sort(F.collect_list(F.struct("idx", *columns))).alias("nodes"))


@dataclass(frozen=True)
class Shape:
    """How many children a parent has, and how many levels a group."""

    fan: int = FAN
    levels: int = LEVELS

    @property
    def span(self) -> int:
        return self.fan**self.levels

    def within(self, size: int) -> int:
        """Levels of a group in a tree of ``size`` nodes."""
        return min(self.levels, height(size, self.fan))


def tops(groups: DataFrame, shape: Shape) -> DataFrame:
    """tree, idx, digest, size: the nodes of the next stage, one for each group."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_top([d.encode() for d in leaves], shape.within(size), shape.fan) for leaves, size in zip(batch["digests"].to_pylist(), batch["size"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["tree"], batch["grp"], pa.array([m.decode() for m in made], pa.string()), batch["size"]], ["tree", "idx", "digest", "size"])

    found = groups.select("tree", "grp", "size", F.col("nodes.digest").alias("digests")).mapInArrow(task, "tree string, idx long, digest string, size long")
    return found.withColumn("size", F.ceil(F.col("size") / shape.span))


_PATH = "tree string, idx long, path array<struct<left: string, right: string>>, top string"


def climbed(groups: DataFrame, shape: Shape) -> DataFrame:
    """tree, idx, path, top: for each node the siblings on its way to its group's top, and that top."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for tree, size, nodes in zip(*(batch[c].to_pylist() for c in ("tree", "size", "nodes")), strict=True):
                levels = grown([x["digest"].encode() for x in nodes], shape.within(size), shape.fan)
                top = levels[-1][0].digest.decode() if levels else nodes[0]["digest"]
                paths = []
                for n in range(len(nodes)):
                    path, at = [], n
                    for level in levels:
                        parent, slot = level[at // shape.fan], at % shape.fan
                        path.append({"left": b"".join(parent.children[:slot]).decode(), "right": parent.right[slot].decode()})
                        at //= shape.fan
                    paths.append(path)
                yield pa.RecordBatch.from_arrays([pa.array([tree] * len(nodes)), pa.array([x["idx"] for x in nodes]), pa.array(paths, kind), pa.array([top] * len(nodes))], ["tree", "idx", "path", "top"])

    return groups.select("tree", "size", "nodes").mapInArrow(task, _PATH)


def ascended(nodes: DataFrame, shape: Shape) -> DataFrame:
    """tree, idx, path, top: for each node the siblings on its way to the one node that is left of its tree, and that node."""
    step = materialize(climbed(grouped(nodes, shape.span, "digest"), shape), "climbed")
    above = materialize(nodes.where(F.col("idx") % shape.span == 0).select("tree", "idx", "size").join(step.select("tree", "idx", "top"), ["tree", "idx"]).select("tree", F.floor(F.col("idx") / shape.span).alias("idx"), F.col("top").alias("digest"), F.ceil(F.col("size") / shape.span).alias("size")), "upper-nodes")
    if above.where("size > 1").isEmpty():
        return step
    rest = ascended(above, shape).select("tree", F.col("idx").alias("grp"), F.col("path").alias("more"), F.col("top").alias("last"))
    met = step.withColumn("grp", F.floor(F.col("idx") / shape.span)).join(rest, ["tree", "grp"])
    return materialize(met.select("tree", "idx", F.concat("path", "more").alias("path"), F.col("last").alias("top")), "paths")


@dataclass(frozen=True)
class Manifest:
    """``groups``: tree, size, grp, nodes (idx, key, digest, other) of all leaves. ``paths``: for each group its siblings up
    to the root, with subroot and root. ``trees``: tree, subroot, root."""

    groups: DataFrame
    paths: DataFrame
    trees: DataFrame
    shape: Shape


def build(leaves: DataFrame, shape: Shape | None = None) -> Manifest:
    """The manifest of ``leaves``: by (string), key (long), digest, and other, the digest that ``folded`` puts in its place."""
    shape = shape or Shape()
    # Bytewise order with null first, without nulls.
    named = leaves.select(F.coalesce(F.concat(F.lit("+"), F.col("by")), F.lit("")).alias("tree"), "key", "digest", "other")
    groups = materialize(grouped(numbered(named, "key", "digest"), shape.span, "key", "digest", "other"), "leaf-groups")
    paths = ascended(materialize(tops(groups, shape), "group-tops"), shape)
    subroots = paths.where("idx = 0").select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("top").alias("digest"))
    last = materialize(numbered(subroots, "name"), "subroots")
    up = ascended(last, shape).select("idx", F.col("path").alias("more"), F.col("top").alias("root"))
    trees = materialize(last.join(up, "idx").select(F.col("name").alias("tree"), F.col("digest").alias("subroot"), "more", "root"), "trees")
    counts = paths.groupBy("tree").agg(F.count(F.lit(1)).alias("n"))
    met = join_counted(paths, trees.join(counts, "tree"), "tree", "n", paths.count())
    return Manifest(groups, met.select("tree", F.col("idx").alias("grp"), F.concat("path", "more").alias("path"), "subroot", "root"), trees.select("tree", "subroot", "root"), shape)


_FOLDED = "key long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def folded(manifest: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root, verified of every leaf.

    The proof is the digest of all siblings on the way to the root; the folded root is
    that of the leaf's replacement with these siblings.
    """
    shape = manifest.shape

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, nodes, path, subroot, root in zip(*(batch[c].to_pylist() for c in ("size", "nodes", "path", "subroot", "root")), strict=True):
                levels = grown([x["digest"].encode() for x in nodes], shape.within(size), shape.fan)
                upper = [(hashlib.sha256(p["left"].encode()), p["right"].encode()) for p in path]
                siblings_above = "".join(p["left"] + p["right"] for p in path).encode()
                proofs, roots = [], []
                for at, x in enumerate(nodes):
                    proof, digest = hashlib.sha256(), x["other"].encode()
                    for level in levels:
                        at, slot = divmod(at, shape.fan)
                        proof.update(level[at].siblings[slot])
                        digest = level[at].fold(slot, digest)
                    for state, right in upper:
                        digest = resumed(state, digest, right)
                    proof.update(siblings_above)
                    proofs.append(proof.hexdigest())
                    roots.append(digest.decode())
                n = len(nodes)
                columns = [pa.array([x["key"] for x in nodes], pa.int64()), pa.array([x["digest"] for x in nodes]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(roots), pa.array([r == root for r in roots])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    met = manifest.groups.join(manifest.paths, ["tree", "grp"])
    return met.select("size", "nodes", "path", "subroot", "root").mapInArrow(task, _FOLDED)


def tampered(docs: DataFrame) -> DataFrame:
    """by, key, digest, other of documents; in every third one, by the CRC-32 of its doc_id, the text's A-Z are a-z in ``other``."""
    rest = [F.col(c) for c in FIELDS[:-1]]
    digest = leaf(*rest, F.col("text"))
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    other = F.when(hit, leaf(*rest, lower_ascii(F.col("text")))).otherwise(digest)
    return docs.select(F.col("lang").alias("by"), F.col("doc_id").cast("long").alias("key"), digest.alias("digest"), other.alias("other"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folded(build(tampered(read_table(spark, sf_dir, "documents")))).withColumnRenamed("key", "doc_id")

"""Merkle dataset manifest: trees of sixteen children, stored as aligned subtrees
in van Emde Boas layout.

Every row's digest is a leaf of its group's tree (one for each source); the
groups' roots are the leaves of one more tree. A tree is cut into aligned
subtrees ("blocks") of at most 16^HEIGHT leaves. A block stores its nodes in
one byte string in van Emde Boas order: its levels are split at half height
into a top tree and the trees below it, each stored contiguously and split
again in the same way. Where a node lies is address arithmetic on its depth and
index alone (:func:`addresses`); building a block and reading the siblings of
its leaves use nothing else. The blocks' roots are the leaves of blocks one
layer up, until a tree is one block; what is above a leaf's block is read from
those blocks, layer by layer downwards.

Scale: leaves are sorted by range over (tree, id, digest, place), so that a tree
of any size and any number of equal rows is dealt over many tasks; a leaf's
position comes from the counts of (tree, task) pairs. A task holds one block at
a time. Layers shrink by 16^HEIGHT; the driver sees only the size of the
largest tree, which gives the number of layers. Every layer is a written table.

Defined cases: a null field is ``-`` in the leaf, an empty text ``0:``; texts of
any length are hashed whole (in Spark, one text in memory at a time). Null ids
come first in their tree, rows of one id ascend by digest, and identical rows
follow each other, each a leaf of its own. A null source is a group, the first
one. A tree of one leaf is that leaf; a run of one node becomes its hash while
its level has others. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorecraft.llm.common import located, small_batches, stage

FAN = 16
#: Levels of edges in a stored block: 256 leaves, 273 nodes.
HEIGHT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_PATH = "array<struct<at: int, run: binary>>"
_ARROW_PATH = pa.list_(pa.struct([("at", pa.int32()), ("run", pa.binary())]))


def leaf_digest(fields: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the fields, each ``-`` or byte count, ``:``, value."""
    parts = [c.cast("string") for c in fields]
    return F.sha2(
        F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]), 256
    )


def tree_key(group: Column) -> Column:
    """A group's key: never null, in the order null, then bytewise."""
    return F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit("-"))


@lru_cache(maxsize=None)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """For each depth of a complete tree, the places of its nodes from left to
    right in van Emde Boas order."""
    if levels == 1:
        return (np.zeros(1, dtype=np.int64),)
    top = levels // 2
    upper, lower = addresses(top), addresses(levels - top)
    at = sum(len(level) for level in upper) + np.arange(FAN**top)[:, None] * sum(len(level) for level in lower)
    return upper + tuple((at + level[None, :]).ravel() for level in lower)


def edges_for(leaves: int) -> int:
    """Levels of edges above so many leaves of a tree that is one block."""
    edges = 0
    while FAN**edges < leaves:
        edges += 1
    return edges


def node_hash(children_hex: bytes) -> bytes:
    return sha256(children_hex).digest()


def build_block(digests: list[bytes], edges: int) -> tuple[bytes, bytes]:
    """``nodes, root`` of a block: its levels from the leaves upwards, each node
    put at its address; places of absent nodes stay zero, the tail is cut."""
    places = addresses(edges + 1)
    end = max(int(places[d][-(-len(digests) // FAN ** (edges - d)) - 1]) for d in range(edges + 1))
    nodes = np.zeros((end + 1, 32), dtype=np.uint8)
    for depth in range(edges, -1, -1):
        nodes[places[depth][: len(digests)]] = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 32)
        if depth:
            text = b"".join(digests).hex().encode()
            digests = [node_hash(text[i : i + 64 * FAN]) for i in range(0, len(text), 64 * FAN)]
    return nodes.tobytes(), digests[0]


def leaf_runs(nodes: bytes, edges: int, leaves: int) -> list[list[bytes]]:
    """For each depth from the leaves up to the one below the root, the runs of
    siblings (hex) from left to right, read by address."""
    flat, places, out = np.frombuffer(nodes, dtype=np.uint8).reshape(-1, 32), addresses(edges + 1), []
    for depth in range(edges, 0, -1):
        count = -(-leaves // FAN ** (edges - depth))
        text = flat[places[depth][:count]].tobytes().hex().encode()
        out.append([text[i : i + 64 * FAN] for i in range(0, len(text), 64 * FAN)])
    return out


def steps_of(runs: list[list[bytes]], leaf: int) -> list[tuple[int, bytes]]:
    """The way from a leaf to its block's root: its place in each run, and the run."""
    out = []
    for level in runs:
        out.append((leaf % FAN, level[leaf // FAN]))
        leaf //= FAN
    return out


def proof_digest(steps: list[tuple[int, bytes]]) -> str:
    """Digest of the siblings of a way, level by level, left to right."""
    digest = sha256()
    for at, run in steps:
        digest.update(run[: 64 * at])
        digest.update(run[64 * at + 64 :])
    return digest.hexdigest()


def fold(digest: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf's digest and its siblings give."""
    for at, run in steps:
        digest = node_hash(run[: 64 * at] + digest.hex().encode() + run[64 * at + 64 :])
    return digest


@dataclass
class Manifest:
    """Written tables of blocks: ``sources`` by layer from the leaves upwards,
    ``top`` the same for the tree over the groups' roots. Columns: tree, block,
    size (leaves of the tree in this layer), edges, nodes, root, first-layer
    blocks also ids and presented digests of their leaves."""

    sources: list[DataFrame]
    top: list[DataFrame]
    cap: int
    id_type: str


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` (with ``tree``) and ``pos``, the place in the tree by ``order``,
    and ``size``, the tree's rows. Sorted by range; only counts are summed."""
    order = ["tree", *order]
    sorted_rows = stage(
        rows.repartitionByRange(*order).sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id()),
        "merkle",
    )
    cells = sorted_rows.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("n"), F.min("mid").alias("first"))
    whole = Window.partitionBy("tree")
    before = F.sum("n").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    cells = cells.select("tree", "part", (before - F.col("first")).alias("shift"), F.sum("n").over(whole).alias("size"))
    return sorted_rows.join(cells, ["tree", "part"]).withColumn("pos", F.col("mid") + F.col("shift"))


def _built(items: DataFrame, cap: int, id_type: str) -> DataFrame:
    """Blocks of ``items``: tree, pos, size, digest, id, presented."""
    groups = items.groupBy("tree", F.floor(F.col("pos") / cap).cast("long").alias("block")).agg(
        F.first("size").alias("size"), F.collect_list(F.struct("pos", "digest", "id", "presented")).alias("items")
    )
    most = edges_for(cap)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                leaves = one.column("items").flatten()
                leaves = leaves.take(pa.array(np.argsort(leaves.field("pos").to_numpy())))
                size = one.column("size")[0].as_py()
                edges = most if size > cap else edges_for(size)
                nodes, root = build_block(leaves.field("digest").to_pylist(), edges)
                span = pa.array([0, len(leaves)], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [one.column("tree"), one.column("block"), one.column("size"), pa.array([edges], pa.int32()),
                     pa.array([len(leaves)], pa.int32()), pa.array([nodes], pa.binary()), pa.array([root], pa.binary()),
                     pa.ListArray.from_arrays(span, leaves.field("id")), pa.ListArray.from_arrays(span, leaves.field("presented"))],
                    names=["tree", "block", "size", "edges", "leaves", "nodes", "root", "ids", "presented"],
                )

    schema = (
        "tree string, block long, size long, edges int, leaves int, nodes binary, root binary, "
        f"ids array<{id_type}>, presented array<binary>"
    )
    return stage(groups.mapInArrow(build, schema), "merkle")


def _layers(items: DataFrame, cap: int, id_type: str) -> list[DataFrame]:
    """Layers of blocks, until every tree is one block."""
    layers = [_built(items, cap, id_type)]
    largest = layers[0].agg(F.max("size")).first()[0] or 0
    while largest > cap:
        below = layers[-1].filter(F.col("size") > cap)
        roots = below.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("size") / cap).cast("long").alias("size"),
            F.col("root").alias("digest"), F.lit(None).cast(id_type).alias("id"), F.lit(None).cast("binary").alias("presented"),
        )
        layers.append(_built(roots, cap, id_type))
        largest = -(-largest // cap)
    return layers


def build_manifest(leaves: DataFrame, height: int = HEIGHT) -> Manifest:
    """The blocks of ``leaves``: ``tree`` (see :func:`tree_key`), ``id``,
    ``digest`` (hex) and ``presented`` (hex or null: a digest to be checked in
    the leaf's stead)."""
    small_batches(leaves.sparkSession)
    cap, id_type = FAN**height, leaves.schema["id"].dataType.simpleString()
    rows = stage(
        leaves.select("tree", "id", F.unhex("digest").alias("digest"), F.unhex("presented").alias("presented")), "merkle"
    )
    sources = _layers(positions(located(rows), ["id", "digest", "__file", "__row"]), cap, id_type)
    roots = sources[0].filter(F.col("size") <= cap)
    for layer in sources[1:]:
        roots = roots.unionByName(layer.filter(F.col("size") <= cap))
    groups = roots.select(
        F.lit("").alias("tree"), F.col("tree").alias("id"), F.col("root").alias("digest"),
        F.lit(None).cast("binary").alias("presented"),
    )
    return Manifest(sources, _layers(positions(groups, ["id"]), cap, "string"), cap, id_type)


def _expanded(blocks: DataFrame, cap: int, id_type: str) -> DataFrame:
    """``tree, block`` (of the layer below)``, id, path, subroot, top`` for the
    leaves of upper blocks that carry their own path."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n = one.column("leaves")[0].as_py()
                runs = leaf_runs(one.column("nodes")[0].as_py(), one.column("edges")[0].as_py(), n)
                above = [(s["at"], s["run"]) for s in one.column("path")[0].as_py()]
                paths = [[{"at": at, "run": run} for at, run in steps_of(runs, leaf) + above] for leaf in range(n)]
                first = one.column("block")[0].as_py() * cap
                same = lambda name: pa.array([one.column(name)[0].as_py()] * n, pa.string())
                yield pa.RecordBatch.from_arrays(
                    [same("tree"), pa.array(range(first, first + n), pa.int64()), one.column("ids").flatten(),
                     pa.array(paths, _ARROW_PATH), same("subroot"), same("top")],
                    names=["tree", "block", "id", "path", "subroot", "top"],
                )

    return blocks.mapInArrow(expand, f"tree string, block long, id {id_type}, path {_PATH}, subroot string, top string")


def _down(layers: list[DataFrame], starts: DataFrame, cap: int, id_type: str) -> DataFrame:
    """First-layer blocks with the path above them. ``starts``: tree, path, top
    (and subroot, or null: the tree's own root) for each tree."""
    paths = None
    for layer in reversed(layers):
        whole = layer.filter(F.col("size") <= cap).join(starts, "tree").withColumn(
            "subroot", F.coalesce("subroot", F.lower(F.hex("root")))
        )
        with_path = whole
        if paths is not None:
            with_path = whole.unionByName(layer.filter(F.col("size") > cap).join(paths, ["tree", "block"]))
        if layer is layers[0]:
            return with_path
        paths = _expanded(with_path, cap, id_type).drop("id")
    raise AssertionError("a manifest has a layer")


def proofs(manifest: Manifest) -> DataFrame:
    """For each leaf: ``id, leaf, subroot, root, proof_sha256, folded_root,
    verified``; what is folded is the presented digest, else the leaf."""
    cap = manifest.cap
    top_root = manifest.top[-1].filter(F.col("size") <= cap).select(
        "tree", F.array().cast(_PATH).alias("path"), F.lower(F.hex("root")).alias("top"), F.lit(None).cast("string").alias("subroot")
    )
    groups = _expanded(_down(manifest.top, top_root, cap, "string"), cap, "string")
    starts = groups.select(F.col("id").alias("tree"), "path", "top", F.lit(None).cast("string").alias("subroot"))
    blocks = _down(manifest.sources, starts, cap, manifest.id_type)

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                n, edges = one.column("leaves")[0].as_py(), one.column("edges")[0].as_py()
                nodes, top = one.column("nodes")[0].as_py(), one.column("top")[0].as_py()
                runs, places = leaf_runs(nodes, edges, n), addresses(edges + 1)[edges]
                above = [(s["at"], s["run"]) for s in one.column("path")[0].as_py()]
                presented = one.column("presented").flatten().to_pylist()
                leaves, proofs_, folded = [], [], []
                for k in range(n):
                    steps = steps_of(runs, k) + above
                    leaf = nodes[32 * places[k] : 32 * places[k] + 32]
                    leaves.append(leaf.hex())
                    proofs_.append(proof_digest(steps))
                    folded.append(fold(presented[k] or leaf, steps).hex())
                yield pa.RecordBatch.from_arrays(
                    [one.column("ids").flatten(), pa.array(leaves, pa.string()),
                     pa.array([one.column("subroot")[0].as_py()] * n, pa.string()), pa.array([top] * n, pa.string()),
                     pa.array(proofs_, pa.string()), pa.array(folded, pa.string()), pa.array([f == top for f in folded], pa.bool_())],
                    names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return blocks.mapInArrow(
        prove,
        f"id {manifest.id_type}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )


def document_leaves(docs: DataFrame, tampered: Column, tamper: Column) -> DataFrame:
    """Leaves of the documents by source; rows where ``tampered`` holds present
    the digest of the row with ``tamper`` as its text."""
    fields = [F.col(c) for c in FIELDS]
    changed = [tamper if c == "text" else F.col(c) for c in FIELDS]
    return docs.select(
        tree_key(F.col("source")).alias("tree"), F.col("doc_id").alias("id"), leaf_digest(fields).alias("digest"),
        F.when(tampered, leaf_digest(changed)).alias("presented"),
    )

"""Near-duplicates by bottom-k sketches.

1. One hash function turns a document's distinct word shingles into 64-bit
   values: its set. Documents with equal sets are one node. The ``K`` smallest
   values are the node's sketch.
2. Inverted lists: a retained value's list holds the nodes that retain it. Two
   sets that are similar enough share at least ``floor_of(...)`` retained
   values (the bound of a binomial tail below ``TAIL``), so a node enters the
   lists of its rarest values only, as many as it takes for two such nodes to
   meet in one. Sets no larger than the sketch are compared by exact bounds.
3. No list is turned into pairs. Each list has a pivot, the node with the most
   widespread values, and every other member is paired with it alone. The
   union sketch (the K smallest of both) estimates the similarity, and pairs
   that may be over ``NEAR`` are measured exactly on the full sets.
4. Members similar enough are linked to the pivot. Those between ``NEAR`` and
   the threshold are compared exactly with all near members of the star, block
   by block, on what each shares with the pivot (a bit mask) and what it has
   besides; only links that join two groups come out.
5. What is left are pairs in a list of which one is far from the pivot and the
   other is not above ``INNER`` (by the triangle inequality of Jaccard's
   distance, others cannot be similar to a far one). They are compared by their
   sketches, block by block, unless they are in one component already; those
   that pass are measured exactly.
6. Links give components.

Scale: exact copies collapse in a partial aggregate. A large group of near
copies costs one comparison each in 3; its list is never expanded. Stars and
lists are dealt in blocks of bounded size. Texts travel only for nodes that
share a list; nothing is collected or broadcast.

Defined cases: null or blank texts have no shingles and link with nothing;
fewer words than a shingle make one shingle of the whole sequence; repeated
rows have equal sets; a null id never is the smallest unless its component has
no other (then ``component_id`` is null and ``kept`` false); texts of any length
give all their shingles, a worker holding one batch of texts; an empty table
gives no rows; other columns are not read, and ``drop_near_duplicates`` keeps
them whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorecraft.llm.common import file_backed, located, scrambled, small_batches, stage
from scorecraft.llm.components import connected_components

WIDTH = 5
#: Similar: PER * intersection >= SIMILAR * union; near: at least NEAR of PER.
PER, SIMILAR, NEAR = 100, 80, 40
#: A member that is more similar to the pivot than this cannot be similar to a far one.
INNER = NEAR + PER - SIMILAR
K = 64
#: Chance that the sketches of a similar pair share fewer values than required.
TAIL = 1e-10
#: Members of a star measured in one group, and the blocks of the comparisons.
STAR_BLOCK, NEAR_BLOCK, OTHER_BLOCK, LIST_BLOCK = 64, 64, 256, 64
WORDS_KEPT = 1 << 18


# -- sets -----------------------------------------------------------------------


def shingle_set(text: str | None, width: int, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle values. ``seen`` keeps words' hashes."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII separators
    if not words:
        return np.empty(0, np.uint64)
    if len(seen) > WORDS_KEPT:
        seen.clear()
    for w in set(words).difference(seen):
        seen[w] = xxhash.xxh3_64_intdigest(w)
    h = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
    take = min(width, len(words))
    value = np.full(len(words) - take + 1, take, np.uint64)
    for i in range(take):
        value = scrambled(value + h[i : len(words) - take + 1 + i])
    return np.unique(value)


def floor_of(size: int, percent: int) -> int:
    """The largest m with P(Binomial(size, percent %) < m) <= TAIL."""
    p, below = percent / PER, 0.0
    for m in range(size + 1):
        below += math.comb(size, m) * p**m * (1 - p) ** (size - m)
        if below > TAIL:
            return m
    return size


def prefix_length(n: int, k: int) -> int:
    """How many of a node's rarest retained values its lists are."""
    if PER * n < SIMILAR * k:  # all similar sets are retained whole
        return n - -(-SIMILAR * n // PER) + 1
    return min(n, k) - floor_of(k, SIMILAR) + 1


def similar(inter, a, b, percent: int = SIMILAR):
    return PER * inter >= percent * (a + b - inter)


def fingerprints(rows: DataFrame, width: int, k: int) -> DataFrame:
    """``__id, __file, __row, n, node, sketch`` of ``__id, __file, __row, __text``."""
    kept = [f for f in rows.schema if f.name != "__text"]

    small_batches(rows.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(t.as_py(), width, seen) for t in batch.column("__text")]
            heads = [s[:k].view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, heads)]).astype(np.int32)
            values = pa.array(np.concatenate(heads) if heads else np.empty(0, np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(f.name) for f in kept],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(ends), values),
                ],
                names=[*[f.name for f in kept], "n", "node", "sketch"],
            )

    schema = T.StructType(list(kept)).add("n", T.LongType()).add("node", T.BinaryType()).add("sketch", T.ArrayType(T.LongType()))
    return rows.mapInArrow(read, schema)


# -- inverted lists -------------------------------------------------------------


def inverted_lists(nodes: DataFrame, k: int) -> DataFrame:
    """``v, node, spread, prefix``: nodes under their rarest values that others
    retain too; ``prefix`` are all of these, rarest first."""
    values = nodes.select("node", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    per_node = values.join(shared, "v").groupBy("node", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"), F.sum("df").alias("spread")
    )
    lengths = F.array(*[F.lit(prefix_length(n, k)) for n in range(1, k + 1)])
    own = F.least("n", F.lit(k)).cast("int")
    take = F.element_at(lengths, own) - (own - F.size("vs"))
    listed = per_node.filter(take > 0).withColumn("prefix", F.slice("vs", F.lit(1), take))
    return listed.select("node", "n", "spread", F.explode("prefix.v").alias("v"), F.col("prefix.v").alias("prefix"))


def union_overlap(a: Column, b: Column, k: int) -> tuple[Column, Column]:
    """Size of the union sketch, and how many of its values both retain."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    return F.size(union), F.size(F.array_intersect(F.array_intersect(union, a), b))


def may_reach(percent: int, size: Column, shared: Column, k: int) -> Column:
    floors = F.array(*[F.lit(floor_of(u, percent)) for u in range(1, k + 1)])
    return shared >= F.element_at(floors, size)


def estimated(pairs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """The pairs (``pivot, node``) whose union sketch allows that they are near."""
    sketches = nodes.select("node", "sketch")
    both = pairs.join(sketches, "node").join(
        sketches.select(F.col("node").alias("pivot"), F.col("sketch").alias("psketch")), "pivot"
    )
    size, shared = union_overlap(F.col("sketch"), F.col("psketch"), k)
    return both.filter(may_reach(NEAR, size, shared, k)).select("pivot", "node")


# -- exact measures ---------------------------------------------------------------


def measured(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``pivot, node, pn, n, inter, mask, extra`` of pairs, from the full sets:
    which of the pivot's values the node has (bits), and its other values. The
    last two are null for pairs that are not near."""
    sized = pairs.join(pairs.groupBy("pivot").agg(F.count(F.lit(1)).alias("c")), "pivot").withColumn(
        "blocks", F.ceil(F.col("c") / STAR_BLOCK).cast("int")
    )
    members = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(texts, "node") \
        .select("pivot", "block", "node", "__text")
    ends = texts.select(F.col("node").alias("base"), F.col("__text").alias("__base_text"))
    pivots = sized.select(F.col("pivot").alias("base"), F.col("blocks").alias("cells")).distinct().join(ends, "base").select(
        "base", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "__base_text"
    )

    def measure(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        seen: dict[bytes, int] = {}
        out = []
        if len(left) and len(right):
            base = shingle_set(right["__base_text"].iloc[0], width, seen)
            for node, text in zip(left["node"], left["__text"]):
                own = shingle_set(text, width, seen)
                has = np.isin(base, own, assume_unique=True)
                inter = int(has.sum())
                near = bool(similar(inter, len(base), len(own), NEAR))
                out.append((
                    left["pivot"].iloc[0], node, len(base), len(own), inter,
                    np.packbits(has).tobytes() if near else None,
                    own[~np.isin(own, base, assume_unique=True)].tobytes() if near else None,
                ))
        return pd.DataFrame(out, columns=["pivot", "node", "pn", "n", "inter", "mask", "extra"])

    return members.groupBy("pivot", "block").cogroup(pivots.groupBy("base", "cell")).applyInPandas(
        measure, "pivot binary, node binary, pn long, n long, inter long, mask binary, extra binary"
    )


class Groups:
    """Disjoint sets of small integers."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.parent[i] = j
        return i != j


def block_links(rows: pd.DataFrame) -> Iterator[tuple[bytes, bytes]]:
    """Links between the unlinked (``near``) and all other rows of one group,
    as few as join the same groups."""
    near, others = np.flatnonzero(rows["near"]), np.flatnonzero(rows["other"])
    masks = np.stack([np.frombuffer(m, np.uint8) for m in rows["mask"]])
    extras = [np.frombuffer(e, np.uint64) for e in rows["extra"]]
    n, nodes, linked = rows["n"].to_numpy(np.int64), rows["node"].tolist(), rows["linked"].to_numpy(bool)
    groups = Groups(len(rows) + 1)
    for i in np.flatnonzero(linked):  # by way of the pivot
        groups.join(int(i), len(rows))
    place = np.concatenate([np.full(len(extras[j]), at) for at, j in enumerate(others)]) if len(others) else np.empty(0)
    values = np.concatenate([extras[j] for j in others]) if len(others) else np.empty(0, np.uint64)
    order = np.argsort(values, kind="stable")
    values, place = values[order], place[order].astype(np.int64)
    for i in near:
        inter = np.bitwise_count(masks[others] & masks[i]).sum(axis=1, dtype=np.int64)
        lo, hi = np.searchsorted(values, extras[i], "left"), np.searchsorted(values, extras[i], "right")
        for a, b in zip(lo[hi > lo], hi[hi > lo]):
            inter[place[a:b]] += 1
        for at in np.flatnonzero(similar(inter, n[others], n[i])):
            j = int(others[at])
            if nodes[j] != nodes[i] and groups.join(int(i), j):
                yield nodes[i], nodes[j]


def near_links(found: DataFrame) -> DataFrame:
    """``a, b``: links of members that are near their pivot but not linked to it."""
    near = found.filter(F.col("mask").isNotNull()).withColumn("linked", similar(F.col("inter"), F.col("pn"), F.col("n")))
    counts = near.groupBy("pivot").agg(
        F.ceil(F.count_if(~F.col("linked")) / NEAR_BLOCK).cast("int").alias("xs"),
        F.ceil(F.count(F.lit(1)) / OTHER_BLOCK).cast("int").alias("ys"),
    ).filter("xs > 0")
    rows = near.join(counts, "pivot").withColumn("x", F.pmod(F.xxhash64("node"), F.col("xs")).cast("int")).withColumn(
        "y", F.pmod(F.xxhash64("node", F.lit(1)), F.col("ys")).cast("int")
    )
    cells = lambda n: F.sequence(F.lit(0), n - 1)
    to = F.array_distinct(F.concat(
        F.when(~F.col("linked"), F.transform(cells(F.col("ys")), lambda y: F.struct(F.col("x").alias("x"), y.alias("y"))))
        .otherwise(F.array()),
        F.transform(cells(F.col("xs")), lambda x: F.struct(x.alias("x"), F.col("y").alias("y"))),
    ))
    dealt = rows.withColumn("to", F.explode(to)).select(
        "pivot", F.col("to.x").alias("bx"), F.col("to.y").alias("by"), "node", "n", "mask", "extra", "linked",
        (~F.col("linked") & (F.col("to.x") == F.col("x"))).alias("near"), (F.col("to.y") == F.col("y")).alias("other"),
    )

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(block_links(rows)), columns=["a", "b"])

    return dealt.groupBy("pivot", "bx", "by").applyInPandas(links, "a binary, b binary")


# -- what is far from the pivots ----------------------------------------------------


def incidence(rows: list[np.ndarray]) -> np.ndarray:
    """Rows by distinct values: 1 where a row has the value."""
    lengths = [len(r) for r in rows]
    values, place = np.unique(np.concatenate(rows), return_inverse=True)
    out = np.zeros((len(rows), len(values)), np.float32)
    out[np.repeat(np.arange(len(rows)), lengths), place] = 1
    return out


def block_candidates(rows: pd.DataFrame, k: int, floors: np.ndarray) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of one group that may be similar, in different components and not
    both near, each only where the group's value is the first that both have
    in their lists."""
    value = int(rows["v"].iloc[0])
    sketches = [np.asarray(s, np.int64).view(np.uint64) for s in rows["sketch"]]
    earlier = [np.asarray(p, np.int64) for p in rows["prefix"]]
    earlier = [p[: int(np.flatnonzero(p == value)[0])] for p in earlier]
    nodes = rows["node"].to_numpy()
    labels = np.unique(rows["label"].to_numpy(), return_inverse=True)[1]
    far, left, right, both = (rows[c].to_numpy(bool) for c in ("far", "left", "right", "both"))
    sizes = np.array([len(s) for s in sketches])
    a, b = np.flatnonzero(left), np.flatnonzero(right)
    has, before = incidence(sketches), incidence(earlier)
    may = has[a] @ has[b].T >= floors[np.minimum.outer(sizes[a], sizes[b])]
    may &= before[a] @ before[b].T == 0
    may &= (labels[a][:, None] != labels[b]) & (far[a][:, None] | far[b])
    for x, y in zip(*np.nonzero(may)):
        i, j = a[x], b[y]
        if both[i] and both[j] and nodes[i] >= nodes[j]:
            continue
        union = np.union1d(sketches[i], sketches[j])[:k]
        shared = np.isin(union, sketches[i], assume_unique=True) & np.isin(union, sketches[j], assume_unique=True)
        if shared.sum() >= floors[len(union)]:
            yield nodes[i], nodes[j]


def far_candidates(lists: DataFrame, found: DataFrame, nodes: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """``pivot, node``: pairs left in the lists (``v, node, pivot, prefix``)."""
    state = found.filter(F.col("mask").isNotNull()).select(
        "pivot", "node", similar(F.col("inter"), F.col("pn"), F.col("n"), INNER).alias("inner")
    )
    rest = lists.filter(F.col("node") != F.col("pivot")).join(state, ["pivot", "node"], "left").filter(
        F.col("inner").isNull() | ~F.col("inner")
    ).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    open_lists = rest.groupBy("v").agg(
        F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("blocks"),
        F.count_if(F.col("inner").isNull()).alias("far"),
        F.min("label").alias("l0"), F.max("label").alias("l1"),
    ).filter("far > 0 AND l0 <> l1").select("v", "blocks")
    rows = rest.join(open_lists, "v").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(
        F.least(o, F.col("own")).alias("x"), F.greatest(o, F.col("own")).alias("y")
    ))
    dealt = rows.withColumn("to", F.explode(cells)).join(nodes.select("node", "sketch"), "node").select(
        "v", F.col("to.x").alias("bx"), F.col("to.y").alias("by"), "node", "label", "prefix", "sketch", F.col("inner").isNull().alias("far"),
        (F.col("own") == F.col("to.x")).alias("left"), (F.col("own") == F.col("to.y")).alias("right"),
        (F.col("to.x") == F.col("to.y")).alias("both"),
    )
    floors = np.array([0] + [floor_of(u, SIMILAR) for u in range(1, k + 1)])

    def candidates(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(block_candidates(rows, k, floors)), columns=["pivot", "node"])

    return dealt.groupBy("v", "bx", "by").applyInPandas(candidates, "pivot binary, node binary")


# -- the operator -------------------------------------------------------------------


def row_groups(docs: DataFrame, id_col: str, text_col: str, width: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(rows, labels) of file-backed ``docs``: ``__id, __file, __row, n, node`` of every row and
    ``node, label`` of the nodes that are linked."""
    rows = located(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    marks = stage(fingerprints(rows, width, k), "near-marks")
    nodes = stage(
        marks.filter("n > 0").groupBy("node").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.min(F.struct("__file", "__row")).alias("at")
        ),
        "near-nodes",
    )
    listed = stage(inverted_lists(nodes, k), "near-lists")
    tops = listed.groupBy("v").agg(F.max(F.struct("spread", "node")).alias("top"), F.count(F.lit(1)).alias("c")) \
        .filter("c > 1").select("v", F.col("top.node").alias("pivot"))
    lists = stage(listed.join(tops, "v").select("v", "pivot", "node", "prefix"), "near-lists")
    ends = lists.select("node").distinct().join(nodes, "node").select(
        "node", F.col("at.__file").alias("__file"), F.col("at.__row").alias("__row")
    )
    texts = stage(rows.select("__file", "__row", "__text").join(ends, ["__file", "__row"]).select("node", "__text"), "near-texts")
    stars = lists.filter(F.col("node") != F.col("pivot")).select("pivot", "node").distinct()
    found = stage(measured(stage(estimated(stars, nodes, k), "near-stars"), texts, width), "near-found")
    direct = lambda f: f.filter(similar(F.col("inter"), F.col("pn"), F.col("n"))).select(
        F.col("pivot").alias("a"), F.col("node").alias("b")
    )
    labels = stage(connected_components(direct(found).union(near_links(found)), "near-components"), "near-labels")
    left = measured(stage(far_candidates(lists, found, nodes, labels, k), "near-far"), texts, width)
    late = stage(direct(left), "near-late")
    if not late.isEmpty():
        known = labels.filter(F.col("node") != F.col("label")).select(F.col("node").alias("a"), F.col("label").alias("b"))
        labels = stage(connected_components(known.union(late), "near-components"), "near-labels")
    return marks.select("__id", "__file", "__row", "n", "node"), labels


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, k: int = K
) -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row, and its locator
    ``__file, __row``."""
    marks, labels = row_groups(file_backed(docs), id_col, text_col, width, k)
    # a document without shingles is a group of its own
    whole = marks.filter("n > 0").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = whole.groupBy("label").agg(F.min("__id").alias("low"))
    linked = whole.join(smallest, "label").select("__id", "n", "low", "__file", "__row")
    alone = marks.filter("n = 0").select("__id", "n", F.col("__id").alias("low"), "__file", "__row")
    return linked.union(alone).select(
        F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"),
        F.coalesce(F.col("__id") == F.col("low"), F.lit(False)).alias("kept"), "__file", "__row",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row of each group, that with the smallest id (of those, the first by
    locator), with the columns of ``docs``; rows without shingles stay."""
    base = file_backed(docs)
    marks, labels = row_groups(base, id_col, text_col, width, K)
    rank = F.min(F.struct(F.col("__id").isNull(), "__id", "__file", "__row")).alias("r")
    whole = marks.filter("n > 0").join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(rank)
    stay = whole.select("r.__file", "r.__row").union(marks.filter("n = 0").select("__file", "__row"))
    names = [f"__c{i}" for i in range(len(docs.columns))]
    named = base.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names)],
        F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"),
    )
    return named.join(stay, ["__file", "__row"], "left_semi").select(*names).toDF(*docs.columns)

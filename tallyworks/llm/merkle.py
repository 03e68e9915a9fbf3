"""Merkle manifest of a dataset by time-forward processing, with a proof for each leaf.

A leaf is the SHA-256 of a document's fields. The leaves of a source ascend by doc_id; runs of 16 become a node until one is
left, the source's subroot; the subroots, ordered by source, become the root in the same way. Nodes are labelled so that
children come before their parent: a node's label is the place behind its last leaf, then its height.

Up: a queue ordered by label delivers child digests to parents. Between tasks the queue is Spark's sorted exchange, by (tree, block)
and place, where a block holds 16^3 nodes of one height; within a block it is a heap, which holds no more than 16
digests a height. A block leaves one digest, so each round has 4,096 times fewer rows, whatever source they come from.
Down: the sweep is reversed. A block gets one message, the runs on the way from its top to the root, as the first row of
its sorted rows, and a heap in reversed order of labels hands each node the runs above it. A leaf thus has its
siblings up to the root, from which proof and folded root come. No task holds more than a block, and a hot source is
as many blocks as any rows of its number.

Ranks within a source come from a range-partitioned sort and one sum for each source and range. Nulls: a null field counts
as `-`; a null doc_id comes first in its source and is never tampered with, as it has no decimal; a null source is a source
of its own and the first. Rows of one doc_id are ordered by leaf; equal rows follow one another and differ at most in their
proof. Empty and very long texts are texts like others. An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, small

FAN, HEIGHT = 16, 3
BLOCK = FAN**HEIGHT
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NODE = "tree string, block long, pos long, n long, digest string, doc_id long, other string, path string, subroot string, root string"


def leaf_digest(*fields: Column) -> Column:
    """SHA-256 of the fields, each as its UTF-8 length and value, or `-`."""
    text = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in text]).cast("binary"), 256)


def leaves(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """tree (the source), doc_id, digest, other: the digest of the document as tampered with, null where it is not."""
    rest = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus == 0
    return docs.select(F.col("source").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*rest, F.col("text")).alias("digest"),
                       F.when(tampered, leaf_digest(*rest, F.translate("text", UPPER, UPPER.lower()))).alias("other"))


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos, their place in their tree by order (nulls first, from 0), and n, the tree's rows."""
    by = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_tie")]
    d = rows.withColumn("_tie", F.spark_partition_id()).repartitionByRange(*by).sortWithinPartitions(*by)
    d = cut(d.drop("_tie").withColumn("_at", F.monotonically_increasing_id()))  # a partition's number, then the place in it
    part = F.shiftright("_at", 33)
    spans = d.groupBy("tree", part.alias("part")).agg(F.min("_at").alias("first"), F.count(F.lit(1)).alias("rows"))
    tree = Window.partitionBy("tree")
    spans = spans.select(F.col("tree").alias("_tree"), F.col("part").alias("_part"), F.sum("rows").over(tree).alias("n"),
                         (F.coalesce(F.sum("rows").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("first")).alias("_shift"))
    out = d.join(small(cut(spans)), F.col("tree").eqNullSafe(F.col("_tree")) & (part == F.col("_part")))
    return out.select(*rows.columns, (F.col("_at") + F.col("_shift")).alias("pos"), "n")


def joined(run: list[str]) -> str:
    return sha256("".join(run).encode()).hexdigest()


def height_of(n: int) -> int:
    """How many heights a block of a tree of n nodes spans."""
    h = 0
    while h < HEIGHT and n > FAN**h:
        h += 1
    return h


def forward(digests: list[str], height: int) -> dict[tuple[int, int], list[tuple[tuple[int, int], str]]]:
    """The children of each node above digests, by its label (place behind its last leaf, height): their labels and digests."""
    count, queue, nodes = len(digests), [], {}

    def send(child: tuple[int, int], digest: str) -> None:
        width = FAN ** (child[1] + 1)
        heapq.heappush(queue, ((min(-(-child[0] // width) * width, count), child[1] + 1), child, digest))

    for i, digest in enumerate(digests):
        if height:
            send((i + 1, 0), digest)
        while queue and queue[0][0][0] <= i + 1:  # nothing before this label is still to come
            label, run = queue[0][0], []
            while queue and queue[0][0] == label:
                run.append(heapq.heappop(queue)[1:])
            nodes[label] = run
            if label[1] < height:
                send(label, joined([d for _, d in run]))
    return nodes


def backward(nodes: dict, count: int, height: int, above: tuple) -> list[tuple]:
    """For each of count digests the way to the root, as (place in the run, the run's digests, the rest of the way)."""
    out: list[tuple] = [above] * count
    queue = [(-count, -height, above)]
    while queue:
        end, h, way = heapq.heappop(queue)
        run = nodes.get((-end, -h))
        if run is None:
            out[-end - 1] = way
            continue
        text = "".join(d for _, d in run)
        for at, ((e, k), _) in enumerate(run):
            heapq.heappush(queue, (-e, -k, (at, text, way)))
    return out


def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(message or None, its nodes) of each block, from rows sorted by tree, block and place."""
    key, message, rows = None, None, []
    for b in batches:
        for r in b.astype(object).where(b.notna(), None).itertuples(index=False, name="Row"):
            if key != (r.tree, r.block):
                if rows:
                    yield message, rows
                key, message, rows = (r.tree, r.block), None, []
            if r.pos < 0:
                message = r
            else:
                rows.append(r)
    if rows:
        yield message, rows


def packed(way: tuple) -> str:
    out = []
    while way:
        out.append(f"{way[0]}:{way[1]}")
        way = way[2]
    return ";".join(out)


def unpacked(path: str) -> tuple:
    way: tuple = ()
    for level in reversed(path.split(";") if path else []):
        at, run = level.split(":")
        way = (int(at), run, way)
    return way


def in_blocks(rows: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in NODE.split(", ")]
    rows = rows.withColumn("block", F.floor(F.col("pos") / BLOCK)) if "block" not in rows.columns else rows
    types = dict(c.split() for c in NODE.split(", "))
    return rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(types[c]).alias(c) for c in names])


def sorted_blocks(rows: DataFrame) -> DataFrame:
    return rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")


def risen(nodes: DataFrame) -> DataFrame:
    """One node a block: its top, numbered by block."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for _, rows in blocks(batches):
            n = int(rows[0].n)
            height = height_of(n)
            up = forward([r.digest for r in rows], height)
            top = joined([d for _, d in up[len(rows), height]]) if height else rows[0].digest
            out.append((rows[0].tree, int(rows[0].block), -(-n // FAN**height), top))
            if len(out) >= 4096:
                yield pd.DataFrame(out, columns=["tree", "pos", "n", "digest"])
                out = []
        yield pd.DataFrame(out, columns=["tree", "pos", "n", "digest"])

    return sorted_blocks(in_blocks(nodes)).mapInPandas(run, "tree string, pos long, n long, digest string")


def rounds(nodes: DataFrame) -> list[DataFrame]:
    """nodes, then the tops of their blocks, and so on until each tree has one."""
    out = [cut(nodes)]
    while (out[-1].agg(F.max("n").alias("n")).first()["n"] or 1) > 1:
        out.append(cut(risen(out[-1])))
    return out


def told(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """The blocks of nodes, each headed by its message: the way above it, its tree's subroot and the root."""
    return sorted_blocks(in_blocks(nodes).unionByName(in_blocks(messages.withColumn("pos", F.lit(-1)))))


def delivered(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """tree, block, other, path, subroot, root: the message to each node, which heads a block of the round below."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m, rows in blocks(batches):
            height = height_of(int(rows[0].n))
            ways = backward(forward([r.digest for r in rows], height), len(rows), height, unpacked(m.path))
            yield pd.DataFrame([(r.tree, int(r.pos), r.digest, r.other, packed(w), m.subroot, m.root) for r, w in zip(rows, ways, strict=True)],
                               columns=["tree", "block", "digest", "other", "path", "subroot", "root"])

    return told(nodes, messages).mapInPandas(run, "tree string, block long, digest string, other string, path string, subroot string, root string")


def proven(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """A row per leaf: its digests and its proof, folded from the leaf as it is now."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for m, rows in blocks(batches):
            height = height_of(int(rows[0].n))
            out = []
            for r, way in zip(rows, backward(forward([r.digest for r in rows], height), len(rows), height, unpacked(m.path)), strict=True):
                now, proof = r.other or r.digest, sha256()
                while way:
                    at, whole, way = way
                    left, right = whole[:64 * at].encode(), whole[64 * at + 64:].encode()
                    proof.update(left)
                    proof.update(right)
                    now = sha256(left + now.encode() + right).hexdigest()
                out.append((r.doc_id, r.tree, r.digest, m.subroot, m.root, proof.hexdigest(), now, now == m.root))
            yield pd.DataFrame(out, columns=["doc_id", "source", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]).astype({"doc_id": "Int64"})

    return told(nodes, messages).mapInPandas(run, "doc_id long, source string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, modulus: int = 5) -> DataFrame:
    """doc_id, source, leaf, subroot, root, proof_sha256, folded_root, verified for each document."""
    up = rounds(placed(leaves(docs, modulus), "doc_id", "digest"))
    subroots = up[-1].select(F.lit("").alias("tree"), "digest", F.col("tree").alias("other"))
    top = rounds(placed(subroots, "other"))
    messages = top[-1].select("tree", F.lit(0).alias("block"), F.lit("").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for nodes in reversed(top):
        messages = cut(delivered(nodes, messages))
    messages = messages.select(F.col("other").alias("tree"), F.lit(0).alias("block"), "path", F.col("digest").alias("subroot"), "root")
    for nodes in reversed(up[1:]):
        messages = cut(delivered(nodes, messages).drop("digest", "other"))
    return proven(up[0], messages)

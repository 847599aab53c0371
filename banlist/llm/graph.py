"""Connected components of a distributed graph, and links inside large groups."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from banlist.llm.workers import ship, slices
from banlist.session import write_table

ship(__name__)

# Members of a group that one block compares with each other, in two halves.
HALF_BLOCK = 512
HALF_BYTES = 8_000_000


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` of every node of edges ``(a, b)``: the least node reachable.

    Edges are contracted to spanning ones where they are made, before any shuffle, and
    after each round. A round is a large-star and a small-star step: each node hands
    its larger, then its smaller neighbours to the least one. A step is a partial
    minimum per node and a join that may be split where a node has very many
    neighbours. Rounds end as soon as the edges are stars, which one grouped pass
    tells; what is a star at once needs no round. Each round is one table below the
    checkpoint folder; nothing is collected but whether it was the last.
    """
    current = write_table(_distinct(edges.where("a <> b")), "edges")
    while not _are_stars(current):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = _distinct(larger.where("a <> b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(least, "a")
        smaller = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", F.col("m").alias("b"))
        )
        current = write_table(_spanning(smaller), "edges")
    # Now every node but the least of its component has one edge, to the least.
    labels = current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())


def _distinct(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _spanning(edges: DataFrame) -> DataFrame:
    """Distinct edges ``a > b`` that connect what the given ones do, batch by batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _edge_batch(batch.column(0).to_numpy(), batch.column(1).to_numpy())

    return _distinct(edges.select("a", "b").where("a <> b").mapInArrow(run, "a long, b long"))


def _edge_batch(first: np.ndarray, second: np.ndarray) -> pa.RecordBatch:
    """Edges to the least node for all that links between two arrays connect."""
    nodes, where = np.unique(np.concatenate([first, second]), return_inverse=True)
    label = least_labels(*np.split(where, 2), len(nodes))
    apart = label != np.arange(len(nodes))
    return pa.RecordBatch.from_arrays([pa.array(nodes[apart]), pa.array(nodes[label[apart]])], ["a", "b"])


def _are_stars(edges: DataFrame) -> bool:
    """Does every node have one edge down and none up, or only edges up?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    counted = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not counted.where((F.col("down") > 1) | ((F.col("down") == 1) & (F.col("up") == 1))).head(1)


def least_labels(first: np.ndarray, second: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the least one that links between two arrays reach."""
    label = np.arange(n)
    while len(first):
        own, other = label[first], label[second]
        apart = own != other
        if not apart.any():
            break
        first, second, own, other = first[apart], second[apart], own[apart], other[apart]
        low = np.minimum(own, other)
        # Roots are hooked to the lower ones, then everything points at its root.
        np.minimum.at(label, own, low)
        np.minimum.at(label, other, low)
        while (label[label] != label).any():
            label = label[label]
    return label


def forest(links: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each member of a block to the least one it is connected with."""
    label = least_labels(*np.nonzero(links), len(nodes))
    heads = np.full(len(nodes), np.iinfo(np.int64).max)
    np.minimum.at(heads, label, nodes)
    least = heads[label]
    apart = least != nodes
    return list(zip(nodes[apart].tolist(), least[apart].tolist()))


Kernel = Callable[[list, np.ndarray], np.ndarray]


def _compare(blocks: DataFrame, kernel: Kernel) -> DataFrame:
    """Edges ``(a, b)`` found inside blocks ``(block, node, payload)``."""

    def block_edges(nodes: list, payloads: list) -> list[tuple[int, int]]:
        own, first = np.unique(np.array(nodes, np.int64), return_index=True)
        if len(own) < 2:
            return []
        return forest(kernel([payloads[i] for i in first], own), own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, nodes, payloads, found = None, [], [], []
        for batch in slices(batches, "payload"):
            for block, node, payload in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if block != now:
                    found += block_edges(nodes, payloads)
                    now, nodes, payloads = block, [], []
                nodes.append(node)
                payloads.append(payload)
            if len(found) > 10_000:
                yield _edge_batch(*np.array(found, np.int64).T)
                found = []
        found += block_edges(nodes, payloads)
        yield _edge_batch(*np.array(found, np.int64).reshape(-1, 2).T)

    sorted_blocks = blocks.repartition("block").sortWithinPartitions("block")
    return sorted_blocks.mapInArrow(run, "a long, b long")


def link_groups(members: DataFrame, kernel: Kernel) -> DataFrame:
    """``(node, label)`` for members ``(grp, node, size, payload)`` of groups: the
    components of all links that the kernel finds between two members of a group.

    The kernel compares the payloads of a block with each other; only a spanning
    forest leaves the block. A group is cut into chunks of bounded rows and
    bytes. Each two neighbouring chunks are a block at first, which joins most
    of what belongs together. What a large group's largest part has not taken
    in is then compared with all its chunks, block by block, so that every pair
    of different parts meets.
    """
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("bytes"))
    sizes = sizes.where("m > 1").withColumn(
        "chunks", F.greatest(F.ceil(F.col("m") / HALF_BLOCK), F.ceil(F.col("bytes") / HALF_BYTES)).cast("int")
    )
    sizes = write_table(sizes.select("grp", "chunks"), "groups")
    chunked = members.join(sizes, "grp").withColumn(
        "chunk", F.expr("cast(pmod(xxhash64(node, 7), chunks) as int)")
    )
    places = F.when(F.col("chunks") < 3, F.array(F.lit(0))).otherwise(
        F.array(F.col("chunk"), F.expr("(chunk + 1) % chunks"))
    )
    ring = chunked.withColumn("at", F.explode(places)).select(
        F.xxhash64("grp", "at").alias("block"), "node", "payload"
    )
    labels = components(_compare(ring, kernel))
    large = chunked.where("chunks > 2")
    if not sizes.where("chunks > 2").head(1):
        return labels
    labels = write_table(labels, "labels")
    known = large.select("grp", "node", "chunk", "chunks", "size").join(labels, "node", "left")
    known = known.withColumn("label", F.coalesce("label", "node"))
    parts = known.groupBy("grp", "label").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("grp").agg(F.max(F.struct("n", "label")).alias("main")).select("grp", "main.label")
    apart = write_table(
        known.join(main.withColumnRenamed("label", "main"), "grp").where("label <> main"), "apart"
    )
    bands = apart.groupBy("grp").agg(
        F.greatest(F.ceil(F.count(F.lit(1)) / HALF_BLOCK), F.ceil(F.sum("size") / HALF_BYTES)).cast("int").alias("bands")
    )
    bands = write_table(bands, "apart-bands")
    payloads = large.join(bands, "grp")
    band = F.expr("cast(pmod(xxhash64(node, 11), bands) as int)")
    ours = (
        payloads.join(apart.select("grp", "node").distinct(), ["grp", "node"])
        .withColumn("band", band)
        .withColumn("at", F.explode(F.expr("sequence(0, chunks - 1)")))
    )
    theirs = payloads.withColumn("band", F.explode(F.expr("sequence(0, bands - 1)"))).withColumn("at", F.col("chunk"))
    blocks = ours.select(F.xxhash64("grp", "band", "at").alias("block"), "node", "payload").union(
        theirs.select(F.xxhash64("grp", "band", "at").alias("block"), "node", "payload")
    )
    # The components so far stand for their links.
    more = write_table(_compare(blocks, kernel), "links")
    if not more.head(1):
        return labels
    return components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

"""From buckets of candidates to connected groups, without listing the pairs of a bucket.

In the first round every bucket has two hubs, its least nodes, and each other node is compared with these alone, so a
bucket of n nodes costs less than 2n comparisons and one of up to three is done. Hubs have then met all of their bucket
and leave it; a bucket whose remaining nodes are all of one group needs no more. For what is still contested, sizes and
the parts that no other contested node has bound every similarity: nodes that can reach no other are done, and the most
central node, which is likeliest to link, is the next hub. What is still open is compared across groups inside of its bucket,
where the bounds allow it, by a join that gives nothing but links; so no link that the buckets propose is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparquill.plans.stage import materialize, may_contain, release

#: One node in SHARE is looked at to find the buckets of more than about SHARE * SEEN nodes.
SHARE, SEEN = 64, 64


@dataclass(frozen=True)
class Likeness:
    """What makes two nodes link.

    payload: (node) -> written (node, payload) of these nodes, one row each, and perhaps of more. match: whether two payloads
    link. own: (node), distinct -> (node, n, u), n the size of a node and u how much of it no other of these nodes has.
    possible: whether nodes of (nx, ux, ny, uy) may link at all. reach: whether one of (n, u) may link to any node whose
    size is at least that given. Neither may exclude a link.
    """

    payload: Callable[[DataFrame], DataFrame]
    match: Callable[[Column, Column], Column]
    own: Callable[[DataFrame], DataFrame]
    possible: Callable[[Column, Column, Column, Column], Column]
    reach: Callable[[Column, Column, Column], Column]


def components(links: DataFrame) -> DataFrame:
    """(a, b) links -> (node, comp): one label for each connected group, for nodes that have a link.

    The graph is contracted: every node moves to the least of itself and its neighbours, links follow and those that
    have become loops go. Nodes are hashes, so their order is random and a constant share of them goes each time; a star
    is done in one step. Moves are composed at the end. Minima combine before they are shuffled.
    """
    edges, moves = links.select("a", "b"), []
    while True:
        both = edges.union(edges.select("b", "a")).toDF("node", "near")
        move = materialize(both.groupBy("node").agg(F.min("near").alias("low")).select("node", F.least("node", "low").alias("comp")), "cc_move")
        moves.append(move)
        to = lambda col: move.select(F.col("node").alias(col), F.col("comp").alias(f"{col}_to"))  # noqa: B023, E731
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("a_to <> b_to")
        before, edges = edges, materialize(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "cc_links")
        if len(moves) > 1:  # the first are the caller's
            release(before)
        if edges.isEmpty():
            break
    out = moves[0]
    for move in moves[1:]:
        after = move.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        out = out.join(after, "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))
    release(edges)
    if len(moves) == 1:
        return out
    out = materialize(out, "cc_labels")
    release(*moves)
    return out


def _only_shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bucket, node) -> those of buckets with two rows or more, with the bucket's least two nodes and size."""
    wait: pa.Table | None = None

    def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        bucket = rows["bucket"].to_numpy()
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(bucket)))
        keep = np.flatnonzero(np.repeat(size > 1, size))
        if len(keep):
            nodes = rows["node"].combine_chunks()
            hub = nodes.take(pa.array(np.repeat(first, size)[keep]))
            second = nodes.take(pa.array(np.repeat(np.minimum(first + 1, len(bucket) - 1), size)[keep]))
            out = rows.take(pa.array(keep)).append_column("hub", hub).append_column("hub2", second)
            out = out.append_column("size", pa.array(np.repeat(size, size)[keep], pa.int64()))
            yield from out.combine_chunks().to_batches()

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if wait is None else pa.concat_tables([wait, rows])
        if not rows.num_rows:
            continue
        bucket = rows["bucket"].to_numpy()
        before = np.flatnonzero(bucket != bucket[-1])  # the last bucket may go on
        cut = int(before[-1]) + 1 if len(before) else 0
        yield from done(rows.slice(0, cut))
        wait = rows.slice(cut)
    if wait is not None:
        yield from done(wait)


def shared_buckets(members: DataFrame) -> DataFrame:
    """(bucket, node) -> the rows of buckets with two nodes or more, with hub and hub2, the bucket's least nodes, and size.

    Most buckets have one node, so they are dropped in one pass after one exchange. A bucket with very many nodes must
    not meet in one task: such buckets are found on a fixed share of the nodes, and their rows take another way, a
    grouped minimum and a join that AQE can split (there hub2 is hub). A bucket on the wrong way gives as good rows.
    """
    seen = members.where(F.pmod(F.xxhash64("node"), F.lit(SHARE)) == 0).groupBy("bucket").agg(F.count(F.lit(1)).alias("seen"))
    heavy = materialize(seen.where(F.col("seen") >= SEEN).select("bucket"), "link_heavy")
    if heavy.isEmpty():
        many, few = None, members
    else:
        many, few = may_contain(members, "bucket", heavy, "bucket")
    kind = members.schema["node"].dataType.simpleString()
    out = few.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(_only_shared, f"bucket long, node {kind}, hub {kind}, hub2 {kind}, size long")
    if many is not None:
        hubs = many.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1")
        out = out.union(many.join(hubs, "bucket").select("bucket", "node", "hub", F.col("hub").alias("hub2"), "size"))
    return out


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """With comp; a node without a link is a group of its own."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def link_buckets(members: DataFrame, like: Likeness) -> DataFrame | None:
    """members: (bucket, node) -> the components of what links, as components() gives them; None where nothing links."""
    first = materialize(shared_buckets(members), "link_members")
    pairs = first.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = pairs.union(first.where("hub2 <> hub and node > hub2").select("hub2", "node"))
    links = _verified(pairs, like)
    comps = None if links.isEmpty() else components(links)
    rest = first.where("(size > 3 or size = 3 and hub2 = hub) and node <> hub and node <> hub2").select("bucket", "node")  # hubs have met all of their bucket; with one hub three nodes leave a pair
    if rest.isEmpty():
        return comps

    def contested(rows: DataFrame) -> DataFrame:
        """Rows of buckets that hold several groups, by the labels of now."""
        rows = materialize(_labelled(rows, comps), "link_rest")
        open_ = rows.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
        out = materialize(rows.join(open_, "bucket", "left_semi"), "link_contested")
        release(rows)
        return out

    rest = contested(rest)
    release(first)
    if rest.isEmpty():
        return comps
    # a node that cannot link even to the bucket's smallest leaves; the most central node is the next hub
    rest = rest.join(materialize(like.own(rest.select("node").distinct()), "link_own"), "node")
    least = rest.groupBy("bucket").agg(F.min("n").alias("least"), F.min(F.struct((F.col("u") / F.col("n")).alias("share"), "node", "comp")).alias("hub"))
    able = rest.join(least, "bucket").where(like.reach(F.col("n"), F.col("u"), F.col("least")))
    able = materialize(able.select("bucket", "node", "comp", "n", "u", F.col("hub.node").alias("hub"), F.col("hub.comp").alias("hub_comp")), "link_able")
    pairs = able.where("node <> hub and comp <> hub_comp").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b"))
    found = _verified(pairs, like)
    if not found.isEmpty():
        links = links.union(found)
        comps = components(links)
    rest = contested(able.where("node <> hub").select("bucket", "node", "n", "u"))
    if rest.isEmpty():
        return comps
    # the join compares inside of a bucket, in the first bucket that two nodes share, and gives nothing but links
    every = rest.groupBy("node").agg(F.sort_array(F.collect_set("bucket")).alias("buckets"))
    rest = materialize(rest.join(every, "node").join(like.payload(rest.select("node")), "node"), "link_blocks")
    side = lambda x: rest.select("bucket", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "comp", "n", "u", "buckets", "payload")])
    a, b = [[F.col(f"{c}_{x}") for c in ("n", "u")] for x in "ab"]
    fits = (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & like.possible(*a, *b) & like.possible(*b, *a)
    fits = fits & (F.array_min(F.array_intersect("buckets_a", "buckets_b")) == F.col("bucket")) & like.match(F.col("payload_a"), F.col("payload_b"))
    found = materialize(side("a").join(side("b"), "bucket").where(fits).select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), "link_found")
    return comps if found.isEmpty() else components(links.union(found))


def _verified(pairs: DataFrame, like: Likeness) -> DataFrame:
    """The distinct pairs that link."""
    pairs = materialize(pairs.distinct(), "link_pairs")
    payload = like.payload(pairs.select(F.explode(F.array("a", "b")).alias("node")))
    both = pairs.join(payload.select(F.col("node").alias("b"), F.col("payload").alias("payload_b")), "b")
    both = both.join(payload.select(F.col("node").alias("a"), F.col("payload").alias("payload_a")), "a")
    found = materialize(both.where(like.match(F.col("payload_a"), F.col("payload_b"))).select("a", "b"), "link_found")
    release(pairs, payload)
    return found

"""Connected components of a link table, with tables of links and labels in the shared folder.

Each round every node takes the least label among its own and its neighbours', then the label of its label, so chains shrink
by halves. Hot nodes are no problem: a node's neighbours meet in an aggregation that is combined before the shuffle, and
the joins have a plain table on both sides, so adaptive execution can split them.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from . import scratch


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """node, label (least node reachable) for every node of links (a, b). labels: of an earlier call, to start from; its
    nodes are kept, and links may then name labels instead of nodes. They are released."""
    pairs = scratch.table(links.select("a", "b").where("a <> b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), "links")
    now = scratch.table(pairs.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")), "labels")
    total = F.sum(F.col("label").cast("decimal(38,0)"))
    sums = now.agg(total).collect()
    while True:
        heard = pairs.join(now.select(F.col("node").alias("a"), "label"), "a").groupBy(F.col("b").alias("node")).agg(F.min("label").alias("heard"))
        met = scratch.table(now.join(heard, "node", "left").select("node", F.least("label", F.coalesce("heard", "label")).alias("label")), "labels")
        jumped = met.join(met.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.least("label", "far").alias("label"))
        new = scratch.table(jumped, "labels")
        scratch.release(now, met)
        now, before = new, sums
        sums = now.agg(total).collect()  # labels only ever fall, so an equal sum means that none did
        if sums == before:
            break
    scratch.release(pairs)
    if labels is None:
        return now
    moved = labels.join(now.select(F.col("node").alias("label"), F.col("label").alias("new")), "label", "left").select("node", F.coalesce("new", "label").alias("label"))
    out = scratch.table(moved.unionByName(now.join(labels, "node", "left_anti")), "labels")
    scratch.release(now, labels)
    return out

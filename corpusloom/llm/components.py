"""Connected components of links that may form groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import FEW_SALTS, discard, every_salt, salt_of, saved


def components(links: DataFrame) -> DataFrame:
    """Columns a, b (same type) in, node and root out: root is the smallest node reachable. Unlinked nodes have no row.

    Each round lets every node point to the smallest root that it, or a neighbour of it, knows, and then follows that
    pointer once, so the distance to the root falls geometrically. Rounds end when no pointer changes. The state is one
    slim row for each node, written to the shared folder in every round; only whether one changed reaches the driver. The
    many links of a node, and the many nodes of a root, are spread over salts where they meet its one row.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = saved(both.withColumn("salt", salt_of(F.col("a"), salts=FEW_SALTS)), "links")
    state = saved(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("root")), "roots")
    while True:
        known = every_salt(state.select(F.col("node").alias("b"), F.col("root").alias("other")))
        offered = edges.join(known, ["b", "salt"]).groupBy(F.col("a").alias("node")).agg(F.min("other").alias("offered"))
        lower = state.join(offered, "node").select("node", F.col("root").alias("was"), F.least("root", "offered").alias("root"))
        # The root of a node also learns what the node learnt, so that trees merge and not only leaves move.
        hooked = lower.where("root < was").groupBy(F.col("was").alias("node")).agg(F.min("root").alias("hook"))
        merged = lower.join(hooked, "node", "left").select("node", "was", F.least("root", "hook").alias("root"))
        merged = saved(merged.withColumn("salt", salt_of(F.col("node"), salts=FEW_SALTS)), "merged")
        # Only a node whose root has moved on tells those that point to it.
        further = every_salt(merged.where("root < node").select(F.col("node").alias("root"), F.col("root").alias("next")))
        jumped = merged.join(further, ["root", "salt"], "left").select("node", "was", F.coalesce("next", "root").alias("root"))
        after = saved(jumped, "roots")
        discard(state, merged)
        state = after.select("node", "root")
        if after.where("root <> was").isEmpty():
            discard(edges)
            return state

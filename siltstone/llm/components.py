"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import forget, settle


def components(edges: DataFrame) -> DataFrame:
    """(node long, component long) for each node of edges (a long, b long); component is the smallest node that can be reached.

    Each round hooks every node to its least neighbour if that is less than itself, follows the hooks twice, and contracts the
    edges; the order is by id at first, which settles stars around their least node at once, and by a new hash in later rounds,
    which keeps chains of hooks short. Contracted edges shrink by a factor each round. Nothing is gathered on the driver; tables of
    a round are settled in the shared folder. Loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession
    left = settle(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    hooks, k = None, 0
    while not left.isEmpty():
        rank = (lambda c: F.col(c)) if k == 0 else (lambda c, s=k: F.xxhash64(F.col(c), F.lit(s)))
        both = left.union(left.select("b", "a"))
        least = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("r"), F.col("b"))).alias("m"))
        hook = settle(least.select(F.col("a").alias("node"), F.when(F.col("m.r") < rank("a"), F.col("m.b")).otherwise(F.col("a")).alias("to")))
        for _ in range(2):
            after = hook.select(F.col("node").alias("to"), F.col("to").alias("next"))
            jumped = settle(hook.join(after, "to").select("node", F.col("next").alias("to")))
            forget(hook)
            hook = jumped
        a, b = (hook.select(F.col("node").alias(c), F.col("to").alias(f"t{c}")) for c in "ab")
        contracted = left.join(a, "a").join(b, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        contracted = settle(contracted)
        forget(left)
        left = contracted
        if hooks is None:
            hooks = hook
        else:
            following = hooks.join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
            composed = settle(following.select("node", F.coalesce("next", "to").alias("to")))
            forget(hooks)
            hooks = composed
        k += 1
    if hooks is None:
        return spark.createDataFrame([], "node long, component long")
    least = hooks.groupBy("to").agg(F.min("node").alias("component"))
    return hooks.join(least, "to").select("node", "component")


def clashing(rows: DataFrame, row_id: str, content: str) -> bool:
    """Whether some id stands for different contents, told by a hash of 64 bits."""
    digest = F.xxhash64(content)
    return not rows.where(F.col(row_id).isNotNull() & F.col(content).isNotNull()).groupBy(row_id).agg(F.min(digest).alias("a"), F.max(digest).alias("b")).where("a <> b").isEmpty()


def by_shared_ids(found: DataFrame) -> DataFrame:
    """found (row, id, component of rows, linked boolean, ...) with component_id in place of component: the smallest id that is reached when
    rows of one id count as linked. Rows that don't link, or have no id, keep their own id.
    """
    members = found.where("linked AND id IS NOT NULL").select("id", "component").distinct()
    firsts = members.groupBy("id").agg(F.min("component").alias("first"))
    joined = components(members.join(firsts, "id").select(F.col("component").alias("a"), F.col("first").alias("b")))
    labels = members.join(joined.select(F.col("node").alias("component"), F.col("component").alias("label")), "component", "left").withColumn("label", F.coalesce("label", "component"))
    least = labels.groupBy("label").agg(F.min("id").alias("least"))
    of = settle(labels.join(least, "label").select("component", "least").distinct())
    apart = ~F.col("linked") | F.col("id").isNull()
    met = found.where(~apart).join(of, "component").withColumn("component_id", F.col("least")).drop("component", "least")
    return met.unionByName(found.where(apart).withColumn("component_id", F.col("id")).drop("component"))

"""Connected components by spreading the smallest label and jumping along it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnera.llm.common import checkpointed

#: Pieces into which the links of one node are dealt; a node may hold most of them.
SALTS = 16


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of comparable nodes to (node, root), root the smallest node reachable.

    Each round takes the smallest label of the neighbours and then that label's own label, so
    rounds grow with the logarithm of a component's diameter.  A link's two ends stay longs
    or strings; only nodes that have links are returned.
    """
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    arcs = checkpointed(both.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS))))
    labels = checkpointed(arcs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")))
    while True:
        salted = labels.select(F.col("node").alias("a"), "root", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
        heard = arcs.join(salted, ["a", "salt"]).select(F.col("b").alias("node"), "root").union(labels)
        nearest = checkpointed(heard.groupBy("node").agg(F.min("root").alias("root")))
        jumped = _jump(nearest)
        following = checkpointed(jumped)
        moved = following.alias("x").join(labels.alias("y"), "node").filter("x.root <> y.root").limit(1).count()
        labels = following
        if not moved:
            return labels


def _jump(labels: DataFrame) -> DataFrame:
    """The label of one's label; a label may be shared by most nodes, so its uses are salted."""
    uses = labels.select("node", F.col("root").alias("via"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    # Only nodes that are someone's label matter on the other side, one row each.
    own = labels.select(F.col("node").alias("via"), "root", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    return uses.join(own, ["via", "salt"]).select("node", "root")

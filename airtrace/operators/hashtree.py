"""Hash trees of fixed fan-out over ordered leaves of any number.

A level hashes ``fan`` consecutive nodes of a group into one, until a group has
one node left. No row holds more than ``fan`` hashes, whatever the group holds,
and there is one small shuffle a level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAN = 256


def tree_roots(leaves: DataFrame, group: list[str], fan: int = FAN) -> DataFrame:
    """``group..., n, root`` from leaves ``group..., at, hash`` with ``at`` counted from 0 without gaps.

    A group of one leaf has that leaf's hash as its root; a node is the SHA-256
    of its children's hex digits in order.
    """
    sizes = leaves.groupBy(*group).agg(F.max(F.col("at") + 1).alias("n"))
    most = sizes.agg(F.max("n")).first()[0] or 0
    nodes = leaves.select(*group, F.col("at").cast("long").alias("at"), "hash").join(sizes.select(*group, F.col("n").alias("_n")), group) if group else leaves.crossJoin(F.broadcast(sizes.withColumnRenamed("n", "_n")))
    while most > 1:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda c: c["hash"]), "")
        whole = F.when(F.first("_n") == 1, F.min("hash")).otherwise(F.sha2(joined, 256))
        nodes = nodes.groupBy(*group, F.floor(F.col("at") / fan).alias("_up")).agg(whole.alias("hash"), F.ceil(F.first("_n") / fan).alias("_n"))
        nodes = nodes.withColumnRenamed("_up", "at")
        most = -(-most // fan)
    roots = nodes.select(*group, F.col("hash").alias("root"))
    return sizes.join(roots, group) if group else sizes.crossJoin(roots)

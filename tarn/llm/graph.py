"""Connected components of an undirected graph by alternating large and small stars, and classes of near duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarn.llm.common import BROADCAST_ROWS, join_small, staged


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1] or 0


def components(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every id in ``pairs``; a component's name is its smallest id.

    Pairs with a null side, and repeated pairs, change nothing; an id paired with itself alone is a component of its own.
    Each round is a few shuffles of id pairs, written to the shared folder; the rounds needed grow with the logarithm of
    the longest chain, and no round gathers a component in one row.
    """
    every = pairs.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = staged(every.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while before != (before := _mark(edges)):
        both = edges.union(edges.select("v", "u"))
        least = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.withColumn("m", least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")).where("u = m").select("u", F.col("m").alias("v"))
        large = large.union(own).distinct()
        down = Window.partitionBy("u")
        small = large.withColumn("m", F.min("v").over(down))
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = staged(hung.union(small.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return edges.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component"))


def contents(names: DataFrame, *more: str, limit: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """Members (id, node) and nodes (node, id, ``more``) from ``names`` (id, one, two, ``more``): a node is a content, told by
    two hashes, and has the columns of its smallest id; an id is a member of each content that it has.

    A group of any size is never gathered: smallest ids are found before and after the shuffle, and the join back is a
    broadcast of counted size or a shuffle whose hot keys Spark splits.
    """
    groups = names.groupBy("one", "two").agg(F.min(F.struct("id", *more)).alias("lead")).withColumn("node", F.monotonically_increasing_id())
    groups = staged(groups, "contents")
    member = join_small(names.select("id", "one", "two").distinct(), groups.select("one", "two", "node"), ["one", "two"], limit=limit)
    return staged(member.select("id", "node"), "members"), groups.select("node", "lead.*")


def classes(member: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, class_id, links) of every id in ``member`` (id, node), given the ``pairs`` (a, b) of nodes that are alike.

    links: other ids with the same content, and ids with a content that pairs with it; where ids have several contents,
    those of each count. class_id: the smallest id that is connected with the id by links. Pairs come once; both tables are
    staged.
    """
    size = member.groupBy("node").agg(F.count("*").alias("n"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    far = both.join(size.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("far"))
    return classes_of(member, pairs.select("a", "b"), far)


def classes_of(member: DataFrame, edges: DataFrame, far: DataFrame) -> DataFrame:
    """What ``classes`` gives, from ``edges`` (a, b) that connect the same nodes as the pairs, and from the members ``far``
    (node, far) of all nodes that pair with each."""
    size = member.groupBy("node").agg(F.count("*").alias("n"))
    several = member.groupBy("id").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1")
    several = several.join(member, "id").select("a", F.col("node").alias("b")).where("a <> b")
    component = components(edges.union(several)).withColumnRenamed("id", "node")
    of_node = size.join(far, "node", "left").join(component, "node", "left")
    of_node = staged(of_node.select("node", F.coalesce("component", "node").alias("component"), (F.col("n") - 1 + F.coalesce("far", F.lit(0))).alias("links")), "links")
    named = staged(join_small(member, of_node, "node").select("id", "component", "links"), "named")
    lowest = staged(named.groupBy("component").agg(F.min("id").alias("class_id")), "classes")
    return join_small(named, lowest, "component").groupBy("id").agg(F.min("class_id").alias("class_id"), F.sum("links").alias("links"))

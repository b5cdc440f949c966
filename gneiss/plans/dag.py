"""Order of chapters by what they depend on."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gneiss.sources.scratch import stored


def topological_levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, level): the longest way to a node from one without prerequisites; null for nodes on a cycle or behind one.

    ``edges`` has (node, needs); those to unknown nodes are ignored. Ways of 2^k steps are joined from two of half the length, so
    there are as many rounds as the depth has binary digits; a node's longest way is then put together from
    the longest pieces down, each of which it holds at most once. Ways as long as there are nodes exist on cycles alone.
    """
    own = nodes.select("node").distinct()
    known = edges.join(own.select(F.col("node").alias("needs")), "needs", "left_semi").join(own, "node", "left_semi")
    n = own.count()
    ways = [stored(known.select("node", "needs").distinct(), "ways")]
    while not ways[-1].isEmpty() and 1 << (len(ways) - 1) <= n:
        step = ways[-1]
        half = step.select(F.col("needs").alias("_at"), F.col("node"))
        ways.append(stored(half.join(step.select(F.col("node").alias("_at"), "needs"), "_at").select("node", "needs").distinct(), "ways"))
    endless = ways.pop() if 1 << (len(ways) - 1) > n or not ways[-1].isEmpty() else None
    reached = own.withColumn("level", F.lit(0))
    for k in reversed(range(len(ways))):
        longer = ways[k].join(reached.select(F.col("node").alias("needs"), F.col("level").alias("_before")), "needs").groupBy("node").agg(F.max("_before").alias("_before"))
        reached = reached.join(longer, "node", "left").select("node", F.greatest("level", F.col("_before") + (1 << k)).alias("level"))
        if k and k % 4 == 0:  # each step reads the one before twice
            reached = stored(reached, "reached")
    if endless is None:
        return reached
    cyclic = endless.select("node").distinct().withColumn("_cyclic", F.lit(True))
    return reached.join(cyclic, "node", "left").select("node", F.when(F.col("_cyclic").isNull(), F.col("level")).alias("level"))


def _in_order(chapters: list[tuple], needs: dict[str, tuple]) -> list[tuple]:
    """Chapters (seq, name) so that each comes after those that it needs, the earliest of those that may come first; cycles at the end."""
    place = {name: seq for seq, name in chapters}
    open_ = {name: sum(p in place for p in set(needs[name])) for name in place}
    followers: dict[str, list] = {}
    for name in place:
        for p in set(needs[name]):
            followers.setdefault(p, []).append(name)
    ready, out = [(place[name], name) for name, n in open_.items() if not n], []
    heapq.heapify(ready)
    while ready:
        seq, name = heapq.heappop(ready)
        out.append((seq, name))
        for f in followers.get(name, ()):
            open_[f] -= 1
            if not open_[f]:
                heapq.heappush(ready, (place[f], f))
    return out + sorted((place[n], n) for n in place.keys() - {n for _, n in out})


def planned_orders(chapters: DataFrame, graph: dict[str, tuple[str, ...]], transversal: tuple[str, ...], key: str) -> DataFrame:
    """(key, chapter, seq, position): the chapters of each document in the order of their work.

    ``chapters`` has (key, seq, chapter). ``graph`` names what each known chapter needs. Known chapters come in the order of their needs, and of
    those that may come next the one that was given first; then transversal ones, then unknown ones, both as given. A need
    that the document lacks is ignored. A chapter that is given twice counts where it is given last. Known chapters of a
    document are as many as the graph has at most; the others are only numbered.
    """
    known = [c for c in graph if c not in transversal]
    kind = F.when(F.col("chapter").isin(*known), 0).when(F.col("chapter").isin(*(c for c in graph if c in transversal)), 1).otherwise(2) if graph else F.lit(2)
    once = chapters.groupBy(key, "chapter").agg(F.max("seq").alias("seq")).withColumn("_kind", kind)

    def order(lists: pd.Series) -> pd.Series:
        return pd.Series([[name for _, name in _in_order([(x["seq"], x["chapter"]) for x in own], graph)] for own in lists], dtype=object)

    lists = once.where("_kind = 0").groupBy(key).agg(F.collect_list(F.struct("seq", "chapter")).alias("_own"))
    placed = lists.select(key, F.posexplode(F.pandas_udf(order, "array<string>")("_own")).alias("_place", "chapter"))
    sorted_ = placed.join(once.where("_kind = 0").select(key, "chapter", "seq"), [key, "chapter"]).select(key, "chapter", "seq", F.col("_place").cast("bigint").alias("_place"), F.lit(0).alias("_kind"))
    rest = once.where("_kind > 0").select(key, "chapter", "seq", F.col("seq").cast("bigint").alias("_place"), "_kind")
    return sorted_.unionByName(rest).select(key, "chapter", "seq", (F.row_number().over(Window.partitionBy(key).orderBy("_kind", "_place", "chapter")) - 1).alias("position"))

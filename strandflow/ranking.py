"""Ranks along lists that are given as links, by doubling pointers in joins: no list is ever one task's work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandflow.lineage import forget, measured, written


def list_ranks(links: DataFrame, tag: str, rounds: int = 64) -> DataFrame:
    """(node, head, pos, circular) for every node of ``links`` (a, b), where a node has one link on and one link back at most. On a list that begins, head is its first
    node; on a ring, its smallest; pos counts the links from there. Nodes are of any type that has an order.

    Each round joins every open node with the one its pointer has come to, which doubles the way: a list of n nodes takes log2 n rounds. While a list has open nodes, some are
    closed in every round, so a round that closes none leaves rings alone; of these the smallest node of the way passed is known, and once that changes nowhere it is the ring's.
    """
    heads = links.select(F.col("a").alias("node")).join(links.select(F.col("b").alias("node")), "node", "left_anti")
    heads = written(heads.select("node", F.col("node").alias("head"), F.lit(0).cast("long").alias("pos"), F.lit(False).alias("circular")), f"{tag}-heads")
    one = links.select(F.col("b").alias("node"), F.col("a").alias("ptr"))
    firsts = one.join(heads.select(F.col("node").alias("ptr")), "ptr", "left_semi").select("node", F.col("ptr").alias("head"), F.lit(1).cast("long").alias("pos"), F.lit(False).alias("circular"))
    closed = [heads, written(firsts, f"{tag}-closed")]
    rest = one.join(closed[1].select("node"), "node", "left_anti")
    # the way back from a node to ptr, which it leaves out: its length, its smallest node, and how far back that is
    count = F.count(F.lit(1))
    live = rest.select("node", "ptr", F.lit(1).cast("long").alias("dist"), F.col("node").alias("low"), F.lit(0).cast("long").alias("back"), F.lit(True).alias("news"))
    live, seen = measured(live, f"{tag}-live", n=count, news=F.count_if("news"))
    moving = True
    for _ in range(rounds):
        if not seen["n"]:
            break
        if moving:
            known = reduce(DataFrame.unionByName, closed).select(F.col("node").alias("ptr"), "head", F.col("pos").alias("_pos"))
            done = live.join(known, "ptr").select("node", "head", (F.col("dist") + F.col("_pos")).alias("pos"), F.lit(False).alias("circular"))
            done, found = measured(done, f"{tag}-closed", n=count)
            moving = found["n"] > 0
            if moving:
                closed.append(done)
                if len(closed) > 8:
                    closed, old = [written(reduce(DataFrame.unionByName, closed), f"{tag}-closed")], closed
                    forget(*old)
        elif not seen["news"]:
            closed.append(live.select("node", F.col("low").alias("head"), F.col("back").alias("pos"), F.lit(True).alias("circular")))
            break
        ahead = live.select(F.col("node").alias("ptr"), F.col("ptr").alias("_ptr"), F.col("dist").alias("_dist"), F.col("low").alias("_low"), F.col("back").alias("_back"))
        nearer = F.col("low") <= F.col("_low")
        both = live.join(ahead, "ptr").select(
            "node", F.col("_ptr").alias("ptr"), (F.col("dist") + F.col("_dist")).alias("dist"), F.when(nearer, F.col("low")).otherwise(F.col("_low")).alias("low"),
            F.when(nearer, F.col("back")).otherwise(F.col("dist") + F.col("_back")).alias("back"), (F.col("_low") < F.col("low")).alias("news"),
        )
        old = live
        live, seen = measured(both, f"{tag}-live", n=count, news=F.count_if("news"))
        forget(old)
    else:
        raise RuntimeError("the lists aren't ranked after so many rounds")
    return reduce(DataFrame.unionByName, closed)

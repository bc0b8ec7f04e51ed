"""Dealing the rows of lists of any length to pairs of bounded blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


def deal_blocks(ws: Workspace, rows: DataFrame, by: str, home: str, block: int, split: int | None = None, within: Column | None = None) -> DataFrame:
    """``rows`` (``by``, ``home``, doc_id, ...) with (lo, hi, side) for each pair of blocks of their list that a row stands in.

    Rows of one ``home`` needn't meet in a list, unless ``within`` says so. Where more than ``block``
    of them do stand in it, they have blocks of their own, which meet all blocks but each other: so a
    crowd is sent once for each block of the others, not once for each of its own. Lists of more
    than ``split`` blocks have up to four times as many rows in each.
    """
    crowd = rows.groupBy(by, home).count()
    apart = F.col("count") > block if within is None else ~within & (F.col("count") > block)
    crowd = ws.cut(crowd.select(by, home, "count", F.when(apart, F.col(home).cast("string")).otherwise("").alias("kind")))
    kinds = crowd.groupBy(by, "kind").agg(F.sum("count").alias("n"))
    blocks = F.ceil(F.col("n") / block)
    if split is not None:
        blocks = F.least(blocks, F.greatest(F.lit(split), F.ceil(F.col("n") / (4 * block))))
    kinds = kinds.withColumn("blocks", blocks.cast("int"))
    # a row for each crowd of a list, and one for its rest
    of_list = Window.partitionBy(by)
    upto = F.sum("blocks").over(of_list.orderBy("kind")).cast("int")
    lists = kinds.select(by, "kind", "blocks", (upto - F.col("blocks")).alias("start"), F.sum("blocks").over(of_list).cast("int").alias("all"))
    lists = ws.cut(crowd.select(by, home, "kind").join(lists, [by, "kind"]))
    dealt = rows.join(lists, [by, home]).withColumn("block", (F.col("start") + F.pmod(F.xxhash64("doc_id"), F.col("blocks"))).cast("int"))
    outside = lambda o: (F.col("kind") == "") | (o < F.col("start")) | (o >= F.col("start") + F.col("blocks"))
    others = F.filter(F.sequence(F.lit(0), F.col("all") - 1), outside)
    pair = lambda o: F.struct(F.least(o, F.col("block")).alias("lo"), F.greatest(o, F.col("block")).alias("hi"), F.when(F.col("block") <= o, 0).otherwise(1).alias("side"))
    return dealt.withColumn("p", F.explode(F.transform(others, pair))).select(*rows.columns, "p.lo", "p.hi", "p.side")

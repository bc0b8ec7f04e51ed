"""Mixing sources to target weights, through a tree of levels such as domain, language and source.

Weights go down the tree. Where a child's share is more than it has (its tokens, times the epochs
allowed), its brothers take over what is missing, by their weights; only what the whole family
lacks goes to the brothers of its parent. A leaf's budget is a number of whole epochs and a prefix
of one more, in an order seeded for each leaf's epochs, which becomes a bound on the order's key:
selection is a filter, and no text is shuffled. Running sums are taken over buckets of keys, finer
ones within the bucket that holds the bound, and at last over the keys of a small bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace

PER_BUCKET = 2_000
#: A table of so many leaves is broadcast: some hundred bytes each.
FEW_LEAVES = 10_000
WORDS = r"[^\x20\x09-\x0D]+"


def share_out(amount: int, weights: Sequence[float], limits: Sequence[int]) -> list[int]:
    """Whole numbers by weight that sum to ``amount``, none over its limit (all limits, if they sum to less)."""
    got, open_ = [0] * len(weights), [i for i in range(len(weights)) if limits[i] > 0 and weights[i] > 0]
    left = min(amount, sum(limits[i] for i in open_))
    while open_ and left:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] / total * left >= limits[i]]
        if not full:
            exact = {i: weights[i] / total * left for i in open_}
            for i in open_:
                got[i] = min(limits[i], math.floor(exact[i]))
            spare = left - sum(got[i] for i in open_)
            for i in sorted(open_, key=lambda i: (got[i] - exact[i], i)):
                more = min(limits[i] - got[i], 1 if spare else 0)
                got[i] += more
                spare -= more
            for i in open_:
                more = min(limits[i] - got[i], spare)
                got[i] += more
                spare -= more
            break
        for i in full:
            got[i] = limits[i]
            left -= limits[i]
        open_ = [i for i in open_ if i not in set(full)]
    return got


def leaf_budgets(tokens: dict[tuple, int], weights: dict[tuple, float], budget: int, epochs: int) -> dict[tuple, int]:
    """A budget for each leaf (a path); ``weights`` by path or prefix of it, 1 where there is none."""
    out: dict[tuple, int] = {}

    def walk(paths: list[tuple], depth: int, amount: int) -> None:
        if len(paths) == 1 and len(paths[0]) == depth:
            out[paths[0]] = amount
            return
        families: dict[tuple, list[tuple]] = {}
        for p in paths:
            families.setdefault(p[: depth + 1], []).append(p)
        names = sorted(families)
        limits = [epochs * sum(tokens[p] for p in families[n]) for n in names]
        for n, part in zip(names, share_out(amount, [weights.get(n, 1.0) for n in names], limits)):
            walk(families[n], depth + 1, part)

    if tokens:
        walk(sorted(tokens), 0, budget)
    return out


def _few(rows: DataFrame, leaves: int) -> DataFrame:
    """A table with a row for each leaf, marked for broadcasting if that is few; else Spark chooses a join."""
    return F.broadcast(rows) if leaves <= FEW_LEAVES else rows


def _last_keys(ws: Workspace, slim: DataFrame, table: DataFrame, leaves: int, key: Column, digits: int) -> DataFrame:
    """(leaf, last): the largest key of each leaf's partial epoch, or a bound below the first key that goes over.

    The bound is found two hexadecimal digits of the key at a time: at most 256 sums a leaf are
    ordered in each round, and then the keys of one bucket. Rows of one key are summed before.
    """
    partial = slim.join(_few(table.where("part > 0"), leaves), "leaf").select("leaf", "part", key.alias("key"), "tokens")
    bound = table.where("part > 0").select("leaf", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("before"))
    for level in range(0, digits, 2):
        inside = partial.join(_few(bound, leaves), "leaf").where(F.substring("key", 1, level) == F.col("prefix"))
        sums = inside.groupBy("leaf", "part", "before", F.substring("key", 1, level + 2).alias("next")).agg(F.sum("tokens").alias("tokens"))
        upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf").orderBy("next"))
        over = sums.withColumn("upto", upto).where("upto > part")  # the first that goes over; those before it are whole
        bound = over.groupBy("leaf").agg(F.min(F.struct("next", (F.col("upto") - F.col("tokens")).alias("before"))).alias("x"))
        bound = ws.cut(bound.select("leaf", F.col("x.next").alias("prefix"), "x.before"))
    inside = partial.join(_few(bound, leaves), "leaf").where(F.substring("key", 1, digits) == F.col("prefix"))
    keys = inside.groupBy("leaf", "part", "before", "key").agg(F.sum("tokens").alias("tokens"))
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("leaf").orderBy("key"))
    last = keys.withColumn("upto", upto).where("upto <= part").groupBy("leaf").agg(F.max("key").alias("last"))
    return ws.cut(bound.join(last, "leaf", "left").select("leaf", F.coalesce("last", "prefix").alias("last")))


def mix_sources(docs: DataFrame, levels: dict[str, Column], weights: dict[tuple, float], budget: int | float, seed: int = 1, epochs: int = 1, id_col: str = "doc_id", text_col: str = "text", as_col: str = "_mix") -> DataFrame:
    """The selected rows of ``docs`` with all their columns, and ``as_col``: epoch, tokens and leaf.

    ``budget``: tokens (words) in all, or a share of the corpus if it is a float. A leaf's partial
    epoch takes the rows, in the order of md5(seed:epoch:id), whose tokens up to and with them fit.
    Null level values are the level's empty value; a null id orders as an empty one; null and empty
    texts have no tokens and follow their key; rows of an equal id go together. Texts may be of any
    length. An empty table gives an empty result. Columns of any name may be there; one named
    ``as_col`` gives way. The table of leaves (a row for each combination of level values, not
    for documents) is brought to the driver.
    """
    ws, names = Workspace(docs.sparkSession), list(levels)
    leaf = F.array(*[F.coalesce(c.cast("string"), F.lit("")) for c in levels.values()])
    words = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORDS)), F.lit(0)).cast("long")
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    key = lambda epoch, i: F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), i).cast("binary"))
    slim = ws.cut(docs.select(ident.alias("ident"), leaf.alias("leaf"), words.alias("tokens")))
    leaves = {tuple(r.leaf): (r.tokens, r.n) for r in slim.groupBy("leaf").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n")).collect()}
    total = sum(t for t, _ in leaves.values())
    budgets = leaf_budgets({p: t for p, (t, _) in leaves.items()}, weights, round(budget * total) if isinstance(budget, float) else budget, epochs)
    rows = [(list(p), b // leaves[p][0] if leaves[p][0] else 0, b % leaves[p][0] if leaves[p][0] else 0) for p, b in sorted(budgets.items())]
    table = docs.sparkSession.createDataFrame(rows, "leaf array<string>, whole long, part long")
    most = max((n for _, n in leaves.values()), default=1)
    digits = 2 * max(0, math.ceil(math.log(max(1, most / PER_BUCKET), 256)))
    last = _last_keys(ws, slim, table, len(rows), key(F.col("whole"), F.col("ident")), digits)
    # Keys are hexadecimal, so that "" is below all of them
    known = table.join(last, "leaf", "left").select("leaf", "whole", F.coalesce("last", F.lit("")).alias("last"))
    row, at = (fresh_name(name, docs.columns) for name in ("row", "leaf"))
    of = lambda name: F.col(f"{at}.{name}")
    known = known.select(F.struct("leaf", "whole", "last").alias(at))
    full = docs.withColumn(row, leaf).join(_few(known, len(rows)), F.col(row) == of("leaf"))
    every = F.when(of("whole") > 0, F.sequence(F.lit(0).cast("long"), of("whole") - 1)).otherwise(F.array().cast("array<long>"))
    more = F.when(key(of("whole"), ident) <= of("last"), F.array(of("whole"))).otherwise(F.array().cast("array<long>"))
    taken = fresh_name("epoch", docs.columns)
    out = full.withColumn(taken, F.explode(F.concat(every, more)))
    fields = [F.col(taken).alias("epoch"), words.alias("tokens"), *[F.col(row)[i].alias(n) for i, n in enumerate(names)]]
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != as_col.lower()], F.struct(*fields).alias(as_col))


def fresh_name(name: str, taken: list[str]) -> str:
    """A column name like ``name`` that isn't among ``taken``."""
    lower = {c.lower() for c in taken}
    while name in lower:
        name = f"_{name}"
    return name

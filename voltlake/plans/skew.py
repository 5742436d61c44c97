"""A lookup join for keys of any skew, for a side too large to broadcast.

AQE splits a partition that came out too large, after the fact was shuffled and only where the join's shape
allows it. Here the hot keys are known before: one pass over the key column finds them with a frequent-items
sketch, which is merged like a sum and shuffles one row per task. A hot key then gets as many salts as its share
of the rows asks for, the looked-up side repeats its row once per salt, and both meet on (key, salt). NULL counts
as a key; its rows match nothing, but would all lie in one task without salts. What the sketch misses or
overestimates costs time only, never a row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlake.sources.tables import fits_broadcast

#: Salts a hot key gets for each partition's worth of rows it holds: more salts spread more evenly.
SPREAD = 8
#: Counters a partition in the sketch; a key of one partition's worth of rows stands far above its error then.
COUNTERS = 8
#: The sketch holds at most a million counters.
MOST_KEYS = 125_000


def hot_keys(fact: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """(hot_key, salts) of the keys with more than a ``SPREAD``-th of a partition's worth of rows, NULL included.

    At most as many rows as there are shuffle partitions, and salts of ``SPREAD`` times that in all.
    """
    partitions = partitions or int(fact.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = min(partitions, MOST_KEYS)
    top = fact.agg(
        F.expr(f"approx_top_k(`{key}`, {keys}, {COUNTERS * keys})").alias("top"), F.count(F.lit(1)).alias("rows"),
    ).select(F.explode("top").alias("top"), "rows")
    share = F.try_divide(F.col("top.count").cast("double"), F.col("rows").cast("double"))
    salts = F.ceil(share * SPREAD * partitions).cast("int")
    return top.select(F.col("top.item").alias("hot_key"), salts.alias("salts")).filter("salts > 1")


def salted_lookup(
    fact: DataFrame, side: DataFrame, key: str, row_key: str, partitions: int | None = None, counted: DataFrame | None = None,
) -> DataFrame:
    """``fact`` left join ``side`` on ``key``; rows of one hot key are dealt over its salts by ``row_key``.

    Returns the key, the fact's and the side's other columns, as a join on the name does. The salt is a hash, so
    a task that is run again deals its rows alike; rows with one ``row_key`` stay together. Hot keys are those of
    ``counted``, where ``fact`` is that table after other lookups, which need not be made for counting.
    """
    # at most one row per shuffle partition
    hot = F.broadcast(hot_keys(fact if counted is None else counted, key, partitions))
    salt = F.coalesce(F.pmod(F.xxhash64(row_key), F.col("salts")).cast("int"), F.lit(0))
    repeats = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts"), F.lit(1)) - 1))
    rows = fact.join(hot, F.col(key).eqNullSafe(F.col("hot_key")), "left").select(*fact.columns, salt.alias("_salt"))
    copies = side.join(hot, F.col(key).eqNullSafe(F.col("hot_key")), "left").select(*side.columns, repeats.alias("_salt"))
    return rows.join(copies, [key, "_salt"], "left").drop("_salt")


def lookups(fact: DataFrame, row_key: str, *sides: tuple[DataFrame, str]) -> DataFrame:
    """``fact`` left join each of ``sides`` (table, key): by broadcast where a side is known to be small, else with
    salted hot keys.

    Joins that shuffle come first, so that what the others look up does not travel. Columns come in no certain order.
    """
    joined = fact
    for side, key in sorted(sides, key=lambda one: fits_broadcast(one[0])):
        if fits_broadcast(side):
            joined = joined.join(side, key, "left")
        else:
            joined = salted_lookup(joined, side, key, row_key, counted=fact)
    return joined

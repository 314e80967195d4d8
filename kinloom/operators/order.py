"""Numbers in a global order and work by groups, without one task for all rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinloom.functions.durable import Workspace

#: Bits of monotonically_increasing_id() that count within a partition.
_WITHIN = (1 << 33) - 1


def numbered(ws: Workspace, df: DataFrame, *keys: str | Column, name: str = "r") -> tuple[DataFrame, DataFrame]:
    """df with a number from 0 in the order of keys, and one row (n) with how many there are.

    Rows are range-partitioned and sorted; each partition's numbers start after the rows of those before it.
    """
    own = ws.store(df.orderBy(*keys).withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND(F.lit(_WITHIN))))
    counts = own.groupBy("__part").agg(F.count("*").alias("c"))
    before = counts.alias("x").join(counts.alias("y"), F.col("x.__part") > F.col("y.__part"), "left").groupBy("x.__part").agg(F.coalesce(F.sum("y.c"), F.lit(0)).alias("__start"))
    out = own.join(F.broadcast(before), "__part").withColumn(name, F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")
    return out, own.agg(F.count("*").alias("n"))


def by_group(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """run(rows) of each group of a whole-number key as one table, dealt over all partitions however few bytes there are."""
    import pandas as pd

    def each(batches):
        held = []
        for b in batches:
            ids = b[key].to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(b)]
            out = []
            for s, e in zip(cuts[:-1], cuts[1:]):
                if held and s < e and held[0][key].iloc[0] != ids[s]:
                    out.append(run(pd.concat(held) if len(held) > 1 else held[0]))
                    held = []
                held += [b.iloc[s:e]] if s < e else []
            if out:
                yield pd.concat(out)
        if held:
            yield run(pd.concat(held))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, key).sortWithinPartitions(key).mapInPandas(each, schema)

"""Pairs of similar names, found by their rarest trigrams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfindex.functions.text import similarity, trigrams


def similar_names(names: DataFrame, block: Sequence[str], at_least: float) -> DataFrame:
    """Block columns, name, other, similarity: both directions of every pair at `at_least` or above.

    `names` has the block columns and `name`; names are compared within a block. Two sets that
    share the fraction t of their union share one of the |set| - ceil(t |set|) + 1 rarest members
    of either. So only these are joined, which leaves common trigrams out, and what meets is verified
    on whole names. A name is similar to itself.
    """
    sets = (
        names.select(*block, "name")
        .distinct()
        .withColumn("grams", F.array_distinct(trigrams(F.col("name"))))
        .filter(F.size("grams") > 0)
    )
    members = sets.select(*block, "name", F.size("grams").alias("n"), F.explode("grams").alias("gram"))
    often = members.groupBy("gram").agg(F.count("*").alias("often"))
    keep = (F.col("n") - F.ceil(at_least * F.col("n") - 1e-9) + 1).cast("int")
    rarest = (
        members.join(often, "gram")
        .groupBy(*block, "name", "n")
        .agg(F.sort_array(F.collect_list(F.struct("often", "gram"))).alias("grams"))
        .select(*block, "name", "n", F.explode(F.slice("grams", F.lit(1), keep)).alias("g"))
        .select(*block, "name", "n", F.col("g.gram").alias("gram"))
    )
    left = rarest
    right = rarest.select(
        *block, F.col("name").alias("other"), F.col("n").alias("m"), "gram"
    )
    near = F.least("n", "m") >= at_least * F.greatest("n", "m") - 1e-9
    met = (
        left.join(right, [*block, "gram"])
        .filter((F.col("name") < F.col("other")) & near)
        .select(*block, "name", "other")
        .distinct()
        .withColumn("similarity", similarity(F.col("name"), F.col("other")))
        .filter(F.col("similarity") >= at_least)
    )
    back = met.select(
        *block, F.col("other").alias("name"), F.col("name").alias("other"), "similarity"
    )
    own = sets.select(*block, "name", F.col("name").alias("other"), F.lit(1.0).alias("similarity"))
    return met.unionByName(back).unionByName(own)

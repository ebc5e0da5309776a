"""Connected components by least labels: every node takes the least label around it, then the label
of its label; each round is one table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuslens.session import durable


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes of the links (a, b); comp is the least node of the component."""
    both = links.select("a", "b").union(links.select("b", "a")).filter("a <> b").distinct()
    both = durable(both)
    labels = durable(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("comp")))
    while True:
        around = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("near"))
        near = labels.join(around.withColumnRenamed("a", "node"), "node").select(
            "node", F.col("comp").alias("old"), F.least("comp", "near").alias("comp")
        )
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("above"))
        after = durable(
            near.join(above, "comp", "left").select("node", "old", F.least("comp", F.coalesce("above", "comp")).alias("comp"))
        )
        labels = after.select("node", "comp")
        if after.filter("old <> comp").isEmpty():
            return labels

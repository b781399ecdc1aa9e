"""Connected components of a table of links, as a small iterative job."""

from pyspark.sql import functions as F

from textdist.session import cut_lineage


def components(links, a="a", b="b"):
    """Rows (v, c) for every end of a link: c is the least v that links reach.

    Each round takes the least label of the neighbours and then the label's own label, so a label travels twice as far every
    round. Labels are written to the shared folder between rounds; one count per round reaches the driver."""
    links = cut_lineage(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct())
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("v"), F.min("b")).alias("c")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "b"), "b").groupBy(F.col("a").alias("v")).agg(F.min("c").alias("m"))
        step = labels.join(near, "v").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = step.select(F.col("v").alias("c"), F.col("c").alias("up"))
        now = cut_lineage(step.join(jump, "c").select("v", F.least("c", "up").alias("c"), "old"))
        if now.where("c <> old").isEmpty():
            return now.select("v", "c")
        labels = now.select("v", "c")

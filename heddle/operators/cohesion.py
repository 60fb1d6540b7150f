"""The headline score: how evenly a data set covers its semantic classes.

Three distributions over classes, each with its entropy (natural logarithm): counts, summed generation
probability, and summed generation probability weighted by cohesion (times the size of the class).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors


def weights(df: DataFrame, class_id: str = "sem_id", vector: str = "embedding", power: float = 1.0) -> DataFrame:
    """Appends ``w``: exp(-distance to the class centroid), of sum 1 in each class."""
    c = vectors.centroids(df, class_id, vector)  # a row per class
    rows = vectors.with_small(df, c, class_id).withColumn("_e", F.exp(-F.pow(vectors.euclidean(F.col(vector), F.col("centroid")), F.lit(power)))).drop("centroid")
    total = rows.groupBy(class_id).agg(F.sum("_e").alias("_t"))
    return vectors.with_small(rows, total, class_id).withColumn("w", F.col("_e") / F.col("_t")).drop("_e", "_t")


def class_report(df: DataFrame, class_id: str = "sem_id", vector: str = "embedding", ln_p: str = "ln_p", size_factor: bool = True, power: float = 1.0) -> DataFrame:
    """Per class: n, p_count, p_generation and p_cohesion."""
    rows = weights(df, class_id, vector, power)
    p = F.exp(F.col(ln_p))
    per = rows.groupBy(class_id).agg(F.count("*").alias("n"), F.sum(p).alias("g"), F.sum(p * F.col("w")).alias("c"))
    if size_factor:
        per = per.withColumn("c", F.col("c") * F.col("n"))
    total = per.agg(F.sum("n").alias("tn"), F.sum("g").alias("tg"), F.sum("c").alias("tc"))
    share = lambda x: F.when(F.col(f"t{x}") > 0, F.col(x) / F.col(f"t{x}"))
    return per.join(F.broadcast(total)).select(class_id, "n", share("n").alias("p_count"), share("g").alias("p_generation"), share("c").alias("p_cohesion"))


def entropy(p: str):
    """-sum p ln p, where 0 ln 0 is 0."""
    return F.coalesce(-F.sum(F.when(F.col(p) > 0, F.col(p) * F.log(p)).otherwise(0.0)), F.lit(0.0))


def entropies(df: DataFrame, **options) -> DataFrame:
    return class_report(df, **options).agg(entropy("p_cohesion").alias("cohesion_entropy"), entropy("p_generation").alias("generation_entropy"), entropy("p_count").alias("count_entropy"))


def round_robin(df: DataFrame, n: int, class_id: str = "sem_id", key: str = "doc_id") -> DataFrame:
    """The n rows met when classes give their best remaining row in turn. ``df`` has ``w``.

    Only rows among the first n of a class can be met. Their ranks come from a sort of whole rows by class;
    an upper bound by the counts of better rows would save little, as classes are many and n is small.
    """
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(class_id).orderBy(F.desc("w"), key))
    return df.withColumn("round", rank).filter(F.col("round") <= n).orderBy("round", class_id).limit(n)

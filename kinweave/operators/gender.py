"""Gender of first names: two name dimensions, then a naive Bayes model of letters, all by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import text as T

SMOOTHING = 0.5


def features(name: Column) -> dict[str, Column]:
    low = F.lower(name)
    return {"first1": F.substring(low, 1, 1), "first2": F.substring(low, 1, 2), "last1": F.right(low, F.lit(1)), "last2": F.right(low, F.lit(2)), "last3": F.right(low, F.lit(3))}


def long_features(df: DataFrame, name: str, *keep: str) -> DataFrame:
    """A row for each letter feature of each name: the columns in keep, feature and value."""
    rows = F.array(*[F.struct(F.lit(k).alias("feature"), v.alias("value")) for k, v in features(F.col(name)).items()])
    return df.select(*keep, F.explode(rows).alias("f")).select(*keep, "f.feature", "f.value")


def train(labelled: DataFrame) -> DataFrame:
    """feature, value, label, logp: naive Bayes with half a count added for each value of a feature seen in training; ('', '') holds the priors."""
    names = labelled.where(T.valid(F.col("name"))).select(F.lower("name").alias("name"), F.lower(F.substring("gender", 1, 1)).alias("label"))
    rows = long_features(names, "name", "label")
    counts = rows.groupBy("feature", "value", "label").agg(F.count("*").alias("n"))
    bins = rows.groupBy("feature").agg(F.countDistinct("value").alias("bins"))
    of = names.groupBy("label").agg(F.count("*").alias("total"))
    # Bins and totals have as many rows as there are features and labels: five and two.
    grid = rows.select("feature", "value").distinct().withColumn("label", F.explode(F.array(F.lit("f"), F.lit("m")))).join(F.broadcast(of), "label").join(F.broadcast(bins), "feature")
    p = F.log((F.coalesce("n", F.lit(0)) + SMOOTHING) / (F.col("total") + SMOOTHING * F.col("bins")))
    table = grid.join(counts, ["feature", "value", "label"], "left").select("feature", "value", "label", p.alias("logp"))
    priors = of.select(F.lit("").alias("feature"), F.lit("").alias("value"), "label", F.log((F.col("total") + SMOOTHING)).alias("logp"))
    return table.unionByName(priors)


def classify(names: DataFrame, model: DataFrame) -> DataFrame:
    """name, gender (f or m) of different names; values not seen in training say nothing."""
    rows = long_features(names, "name", "name").unionByName(names.select("name", F.lit("").alias("feature"), F.lit("").alias("value")))
    scores = rows.join(model, ["feature", "value"]).groupBy("name", "label").agg(F.round(F.sum("logp"), 9).alias("score"))
    return scores.groupBy("name").agg(F.max(F.struct("score", "label")).alias("best")).select("name", F.col("best.label").alias("gender"))


def name_dimension(dim: DataFrame) -> DataFrame:
    """One row a name; of several genders the first by letter."""
    return dim.where(T.valid(F.col("name"))).groupBy(F.lower("name").alias("name")).agg(F.min(F.lower(F.substring("gender", 1, 1))).alias("gender"))


def predict(df: DataFrame, names_us_ca: DataFrame | None = None, names_row: DataFrame | None = None, labelled: DataFrame | None = None, first_nm: str = "first_nm") -> DataFrame:
    """df with gender: of the US/CA names, else of the rest of the world, else by the model; '' where the name is blank or none knows it."""
    names = df.where(T.valid(F.col(first_nm))).select(F.lower(first_nm).alias("name")).distinct()
    found = names.withColumn("gender", F.lit(None).cast("string"))
    for dim in (names_us_ca, names_row):
        if dim is not None:
            found = found.join(name_dimension(dim).withColumnRenamed("gender", "_g"), "name", "left").select("name", F.coalesce("gender", "_g").alias("gender"))
    if labelled is not None:
        said = classify(found.where("gender is null").select("name"), train(labelled)).withColumnRenamed("gender", "_g")
        found = found.join(said, "name", "left").select("name", F.coalesce("gender", "_g").alias("gender"))
    found = found.withColumnRenamed("name", "_name")
    return df.drop("gender").join(found, F.lower(first_nm) == F.col("_name"), "left").drop("_name").withColumn("gender", F.coalesce("gender", F.lit("")))

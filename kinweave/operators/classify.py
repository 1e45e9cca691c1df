"""Deterministic and trained classification of candidate pairs."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions import kernels as K
from kinweave.functions import text as T

#: Similarity of two values of which one is unknown.
UNKNOWN = 0.1
FEATURES = [
    "either_null_first_nm", "either_null_last_nm", "either_null_email_address", "either_null_address", "either_null_gender",
    "same_fn", "approx_fn", "same_first_nm_sdx", "same_first_nm_mp", "jw_simi_fn", "lev_ratio_fn", "damerau_lev_simi_fn",
    "same_ln", "approx_ln", "same_last_nm_sdx", "same_last_nm_mp", "jw_simi_ln", "same_email_address", "same_address", "same_gender",
]


def _sides(role: str) -> tuple[Column, Column]:
    return F.col(f"{role}_1"), F.col(f"{role}_2")


def _missing(c: Column) -> Column:
    return ~F.coalesce(T.valid(c), F.lit(False))


def rule_features(pairs: DataFrame) -> DataFrame:
    """either_null_* and both_null_* of each role there is, approx_fn, approx_ln (equality of known names) and same_email_address."""
    out: dict[str, Column] = {}
    for role in ("first_nm", "last_nm", "email_address"):
        if f"{role}_1" in pairs.columns:
            a, b = _sides(role)
            out[f"either_null_{role}"] = T.flag(_missing(a) | _missing(b))
            out[f"both_null_{role}"] = T.flag(_missing(a) & _missing(b))
            name = {"first_nm": "approx_fn", "last_nm": "approx_ln", "email_address": "same_email_address"}[role]
            out[name] = T.flag(T.both_valid(a, b) & (a == b))
    return pairs.withColumns(out)


def rule_match(pairs: DataFrame) -> DataFrame:
    """prediction: pairs of one device with equal known names, both of them, or equal known e-mails. Pairs share a device already."""
    have = lambda c: F.col(c) == 1 if c in pairs.columns else F.lit(False)
    return pairs.withColumn("prediction", T.flag(have("approx_fn") & have("approx_ln") | have("same_email_address")))


def _codes(pairs: DataFrame, roles: list[str]) -> DataFrame:
    """Sound codes of both sides' names. Metaphone is worked out once for each different name of a batch."""
    return pairs.withColumns({f"{r}_{i}_{n}": f(F.coalesce(F.col(f"{r}_{i}"), F.lit(""))) for r in roles for i in (1, 2) for n, f in (("sdx", T.soundex), ("mp", K.metaphone_code))})


def model_features(pairs: DataFrame) -> DataFrame:
    """pairs with the indicators and similarities of every role it has; a role with only one side is an error."""
    roles = ["first_nm", "last_nm", "email_address", "email_user", "address", "gender", "phone", "household_id"]
    for r in roles:
        if (f"{r}_1" in pairs.columns) != (f"{r}_2" in pairs.columns):
            raise ValueError(f"{r} is there for one record of the pair only")
    roles = [r for r in roles if f"{r}_1" in pairs.columns]
    names = [r for r in ("first_nm", "last_nm") if r in roles]
    df = _codes(pairs, names)
    out: dict[str, Column] = {}
    for r in roles:
        a, b = _sides(r)
        out[f"either_null_{r}"] = T.flag(_missing(a) | _missing(b))
        out[f"both_valid_{r}"] = T.flag(T.both_valid(a, b))
    similar = lambda kind, a, b: F.when(T.both_valid(a, b), K.pair_function(kind, a, b)).otherwise(F.lit(UNKNOWN))
    for r in names:
        a, b = _sides(r)
        s = {"first_nm": "fn", "last_nm": "ln"}[r]
        known = T.both_valid(a, b)
        out |= {f"same_{s}": T.flag(known & (a == b)), f"approx_{s}": T.contained(a, b)}
        out |= {f"same_{r}_{n}": T.flag(known & (F.col(f"{r}_1_{n}") == F.col(f"{r}_2_{n}"))) for n in ("sdx", "mp")}
        out |= {f"jw_simi_{s}": similar("gen_jw", a, b), f"lev_ratio_{s}": similar("gen_lev", a, b), f"damerau_lev_simi_{s}": similar("gen_damerau", a, b)}
    for r, name in (("email_address", "same_email_address"), ("email_user", "approx_email_address"), ("address", "same_address"), ("gender", "same_gender")):
        if r in roles:
            a, b = _sides(r)
            out[name] = T.flag(T.both_valid(a, b) & (a == b))
    if "address" in roles:
        out["jw_simi_address"] = similar("gen_jw", *_sides("address"))
    if len(names) == 2 and "email_user" in roles:
        out["first_nm_in_email"] = T.name_in_email(F.col("first_nm_1"), F.col("first_nm_2"), F.col("email_user_1"))
    return df.withColumns(out)


def train(labelled: DataFrame, x_cols: list[str], target: str, seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees over the feature columns; the target is 0 or 1."""
    trees = GBTClassifier(featuresCol="features", labelCol=target, maxIter=10, maxDepth=4, seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=x_cols, outputCol="features"), trees]).fit(labelled)


def predictions(model: PipelineModel, pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """prob_1 (float), prob_0 and prediction: 1 where prob_1 is above the threshold."""
    df = model.transform(pairs.drop("prediction")).drop("prediction", "rawPrediction", "features")
    df = df.withColumn("prob_1", vector_to_array("probability")[1].cast("float")).drop("probability")
    return df.withColumns({"prob_0": F.lit(1) - F.col("prob_1"), "prediction": T.flag(F.col("prob_1") > threshold)})

"""Severity classifier and anomaly detector on exported training rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF, CountVectorizer, MaxAbsScaler, NGram, Normalizer, OneHotEncoder, RegexTokenizer, SQLTransformer, StringIndexer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duskwatch.functions import severity as sev
from duskwatch.plans.kept import kept
from duskwatch.plans.tiles import first_n
from duskwatch.schema import SEVERITIES

# The columns of the training table.
TEXT_COLUMNS = ["target_url", "user_agent", "text", "threat_type", "threat_level", "method"]
NUMBERS = ["ddos_score", "payload_length", "blocked", "ai_score", "ai_confidence"]
CATEGORIES = ["threat_type", "threat_level", "method", "action"]
VOCABULARY = 5000


def normal_label(value: Column) -> Column:
    raw = F.trim(value.cast("string"))
    up = F.upper(raw)
    return (F.when(raw == "0", "INFO").when(raw == "1", "MEDIUM").when(raw == "2", "HIGH")
            .when(raw.isin("3", "4"), "CRITICAL").when(up.isin(SEVERITIES), up).otherwise("INFO"))


def prepare_features(rows: DataFrame) -> DataFrame:
    """Filled and cast model columns, the combined text and the normal label."""
    have = set(rows.columns)

    def text(c: str) -> Column:
        return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")

    out = {"combined_text": F.trim(F.concat_ws(" ", *[text(c) for c in TEXT_COLUMNS]))}
    for c in NUMBERS:
        out[c] = F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    for c in CATEGORIES:
        out[c] = F.coalesce(F.nullif(text(c), F.lit("")), F.lit("unknown"))
    if "label" in have:
        out["label"] = normal_label(F.col("label"))
    return rows.withColumns(out)


class Dampen(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage: counts ``n`` of a vector become ``1 + ln(n)``, zeros stay; null stays null.

    A vector is a struct below its type, of which only the values change, so sparse ones stay sparse. Going back
    to the type takes a JSON reader, as no cast leads there. No row leaves the JVM.
    """

    def __init__(self, inputCol: str | None = None, outputCol: str | None = None):
        super().__init__()
        self._set(**{k: v for k, v in (("inputCol", inputCol), ("outputCol", outputCol)) if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        vector = F.unwrap_udt(F.col(self.getInputCol()))
        damped = vector.withField("values", F.transform(vector["values"], lambda n: F.when(n > 0, 1 + F.log(n)).otherwise(n)))
        schema = T.StructType([T.StructField("v", VectorUDT())])
        text = F.to_json(F.struct(F.when(vector.isNotNull(), damped).alias("v")))
        return dataset.withColumn(self.getOutputCol(), F.from_json(text, schema)["v"])


def severity_pipeline(rows: int) -> Pipeline:
    """Word and word-pair weights from dampened counts, of unit length, one-hot categories and scaled numbers into a logistic regression.

    The penalty on the weights is that of one more row among ``rows``.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol="combined_text", outputCol="_words", pattern=r"\b\w\w+\b", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
        CountVectorizer(inputCol="_terms", outputCol="_counts", vocabSize=VOCABULARY, minDF=1.0),
        Dampen(inputCol="_counts", outputCol="_damped"),
        IDF(inputCol="_damped", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_tfidf", p=2.0),
        StringIndexer(inputCols=CATEGORIES, outputCols=[f"_i_{c}" for c in CATEGORIES], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"_i_{c}" for c in CATEGORIES], outputCols=[f"_o_{c}" for c in CATEGORIES]),
        VectorAssembler(inputCols=NUMBERS, outputCol="_numbers"),
        MaxAbsScaler(inputCol="_numbers", outputCol="_scaled"),
        VectorAssembler(inputCols=["_tfidf", *[f"_o_{c}" for c in CATEGORIES], "_scaled"], outputCol="features"),
        LogisticRegression(labelCol="label_index", featuresCol="features", weightCol="class_weight", maxIter=50,
                           regParam=1.0 / max(rows, 1), family="multinomial"),
    ])


def _indexed(rows: DataFrame) -> DataFrame:
    return prepare_features(rows).withColumn("label_index", sev.rank(F.col("label")).cast("double"))


def train_severity_model(rows: DataFrame, *, key: list[str], test: Column | None = None) -> tuple[PipelineModel, DataFrame]:
    """Fit on four fifths of the rows and report per class on the rest.

    Rows are split by a hash of their key, so the split is the same every time, or by ``test``.
    Classes weigh alike. Returns the model and a report with one row per class.

    Texts are read twice, for the vocabulary and for the dampened counts, which are kept in the shared folder; all other stages and the report
    work on these.
    """
    frame = _indexed(rows).withColumn("_test", F.pmod(F.xxhash64(*key), F.lit(5)) == 0 if test is None else test)
    counts = frame.filter(~F.col("_test")).groupBy("label_index").agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_k")).withColumn("_j", F.lit(1))
    weights = counts.withColumn("_j", F.lit(1)).join(total, "_j").select(
        "label_index", "_all", (F.col("_all") / (F.col("_k") * F.col("_n"))).alias("class_weight"))
    told = weights.collect()  # one row per class
    stages = severity_pipeline(told[0]["_all"] if told else 0).getStages()
    texts = 1 + next(i for i, s in enumerate(stages) if isinstance(s, Dampen))
    used = frame.select("combined_text", *NUMBERS, *CATEGORIES, "label_index", "_test")
    counting = Pipeline(stages=stages[:texts]).fit(used.filter(~F.col("_test")))
    counted = kept(counting.transform(used.filter("_test IS NOT NULL")).drop("combined_text", "_words", "_pairs", "_terms", "_counts"))
    # The weights of at most five classes, already here.
    weight = reduce(lambda other, r: F.when(F.col("label_index") == r["label_index"], r["class_weight"]).otherwise(other), told, F.lit(None).cast("double"))
    fitted = Pipeline(stages=stages[texts:]).fit(counted.filter(~F.col("_test")).withColumn("class_weight", weight))
    return PipelineModel(stages=counting.stages + fitted.stages), class_report(fitted.transform(counted.filter("_test")))


def class_report(predicted: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per severity."""
    pairs = predicted.groupBy("label_index", "prediction").agg(F.count("*").alias("n"))
    per = pairs.select(F.explode(F.array(
        F.struct(F.col("label_index").alias("c"), F.lit(1).alias("actual"), F.lit(0).alias("said"), "n",
                 (F.col("label_index") == F.col("prediction")).cast("int").alias("right")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).alias("actual"), F.lit(1).alias("said"), "n",
                 F.lit(0).alias("right")))).alias("x")).groupBy(F.col("x.c").alias("c")).agg(
        F.sum(F.expr("x.n * x.actual")).alias("support"), F.sum(F.expr("x.n * x.said")).alias("predicted"),
        F.sum(F.expr("x.n * x.right")).alias("correct"))
    p = F.when(F.col("predicted") > 0, F.col("correct") / F.col("predicted")).otherwise(0.0)
    r = F.when(F.col("support") > 0, F.col("correct") / F.col("support")).otherwise(0.0)
    return per.select(sev.from_rank(F.col("c")).alias("label"), F.round(p, 4).alias("precision"),
                      F.round(r, 4).alias("recall"),
                      F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"), "support")


def score_with_model(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Class probabilities as expected severity over 4, label and confidence."""
    out = model.transform(prepare_features(rows).withColumn("class_weight", F.lit(1.0)))
    probs = vector_to_array("probability")
    expected = F.aggregate(
        F.transform(probs, lambda p, i: p * i), F.lit(0.0), lambda acc, x: acc + x)
    return out.withColumn("_p", probs).select(
        *rows.columns, F.round(F.least(F.lit(1.0), expected / 4), 3).alias("model_score"),
        sev.label_of_index(F.col("prediction")).alias("predicted_label"),
        F.round(F.array_max("_p"), 3).alias("model_confidence"))


# ---- isolation forest -------------------------------------------------------------------

TREE_SCHEMA = ("tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, "
               "length array<double>")


def average_path(n: float) -> float:
    """Mean path length of an unsuccessful search in a binary tree of ``n`` rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow(tree: int, x: np.ndarray, limit: int) -> dict:
    rng = np.random.default_rng(tree)
    feature: list[int] = []
    threshold: list[float] = []
    left: list[int] = []
    right: list[int] = []
    length: list[float] = []

    def node(rows: np.ndarray, depth: int) -> int:
        me = len(feature)
        for lst, v in ((feature, -1), (threshold, 0.0), (left, -1), (right, -1),
                       (length, depth + average_path(len(rows)))):
            lst.append(v)
        spread = rows.max(axis=0) - rows.min(axis=0) if len(rows) > 1 else np.zeros(x.shape[1])
        usable = np.flatnonzero(spread > 0)
        if depth >= limit or len(usable) == 0:
            return me
        f = int(rng.choice(usable))
        cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
        below = rows[:, f] < cut
        if below.all() or not below.any():
            return me
        feature[me], threshold[me] = f, cut
        left[me] = node(rows[below], depth + 1)
        right[me] = node(rows[~below], depth + 1)
        return me

    node(x, 0)
    return {"tree": tree, "feature": feature, "threshold": threshold, "left": left, "right": right, "length": length}


def train_anomaly_model(
    rows: DataFrame, *, key: list[str], features: list[str] = NUMBERS, trees: int = 100, sample: int = 256,
    contamination: float = 0.02,
) -> dict:
    """Isolation forest: each tree grows in its own task from at most ``sample`` rows.

    Rows are drawn by hash, so at any table size only a few ten thousand reach
    the trees. The model is ``trees`` small node lists and the score below which
    the given share of the table lies.
    """
    frame = prepare_features(rows).select(*key, *features)
    n = max(1, frame.count())
    # Every row comes as often as its share of twice the rows that the trees need, fractions by hash.
    share = 2 * trees * sample / n
    part = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = F.floor(F.lit(share)) + F.when(part < share - math.floor(share), 1).otherwise(0)
    drawn = frame.withColumn("_copy", F.explode(F.filter(F.sequence(F.lit(0), F.lit(math.floor(share))), lambda i: i < times)))
    dealt = drawn.withColumn("_h", F.xxhash64(*key, "_copy", F.lit(1))).withColumn(
        "tree", F.pmod(F.xxhash64("_h"), F.lit(trees)).cast("int"))
    chosen = first_n(dealt, ["tree"], ["_h", *key], sample).select("tree", *features)
    limit = math.ceil(math.log2(max(sample, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([_grow(int(pdf["tree"].iloc[0]), pdf[features].to_numpy(float), limit)])

    # One row of at most 2 * sample nodes per tree: a fixed size, whatever the table.
    nodes = chosen.groupBy("tree").applyInPandas(grow, TREE_SCHEMA).orderBy("tree").toPandas()
    model = {"features": features, "trees": nodes.to_dict("records"), "scale": average_path(min(sample, n)),
             "offset": 0.0}
    scores = score_anomalies(model, rows).agg(F.percentile_approx("raw_score", contamination, 10000)).first()[0]
    model["offset"] = float(scores)
    return model


def _depths(model: dict, x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for t in model["trees"]:
        f, cut = np.asarray(t["feature"]), np.asarray(t["threshold"])
        left, right, length = np.asarray(t["left"]), np.asarray(t["right"]), np.asarray(t["length"])
        at = np.zeros(len(x), dtype=int)
        inner = f[at] >= 0
        while inner.any():
            rows = np.flatnonzero(inner)
            here = at[rows]
            goes_left = x[rows, f[here]] < cut[here]
            at[rows] = np.where(goes_left, left[here], right[here])
            inner = f[at] >= 0
        total += length[at]
    return total / len(model["trees"])


def score_anomalies(model: dict, rows: DataFrame) -> DataFrame:
    """``raw_score`` (negative, lower is odder) less the offset, its sigmoid and the verdict."""
    features = model["features"]
    held = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def raw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        m = held.value
        for part in parts:
            yield pd.Series(-np.power(2.0, -_depths(m, part.to_numpy(float)) / m["scale"]))

    frame = prepare_features(rows)
    numbers = F.struct(*[F.col(c) for c in features])
    decision = F.col("_raw") - F.lit(model["offset"])
    return frame.withColumn("_raw", raw(numbers)).select(
        *rows.columns, F.round(decision, 5).alias("raw_score"),
        F.round(1 / (1 + F.exp(decision)), 3).alias("anomaly_score"), (decision < 0).alias("is_anomaly"))

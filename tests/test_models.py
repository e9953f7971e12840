"""The severity model: weights by hand, saved and loaded, and figures that a wrong model misses."""

import math

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from duskwatch.operators import models


def test_dampened_counts(spark):
    rows = [(Vectors.sparse(6, {1: 1.0, 4: 8.0}),), (Vectors.dense([0.0, 2.0]),), (Vectors.sparse(6, {}),), (None,)]
    out = [r["w"] for r in models.Dampen("v", "w").transform(spark.createDataFrame(rows, ["v"])).collect()]
    assert out[0] == Vectors.sparse(6, {1: 1.0, 4: 1 + math.log(8)}) and out[1] == Vectors.dense([0.0, 1 + math.log(2)])
    assert out[2] == Vectors.sparse(6, {}) and out[3] is None


@pytest.fixture(scope="module")
def told(spark):
    """Texts of which one word, in one of twenty places, tells the severity."""
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    tells = {"INFO": "calm", "MEDIUM": "odd", "CRITICAL": "breach"}
    rows = [(i, " ".join([words[(i * k) % 5] for k in range(1, 1 + i % 20)] + [tells[label]] + [words[(i + k) % 5] for k in range(20 - i % 20)]), label)
            for i, label in enumerate(["INFO", "MEDIUM", "CRITICAL", "INFO"] * 100)]
    return spark.createDataFrame(rows, "doc_id int, text string, label string")


def test_weights_by_hand_and_reloading(spark, told, tmp_path):
    held_out = F.col("doc_id") % 5 == 0
    model, report = models.train_severity_model(told, key=["doc_id"], test=held_out)
    got = {r["label"]: r["f1"] for r in report.collect()}
    assert set(got) == {"INFO", "MEDIUM", "CRITICAL"} and min(got.values()) >= 0.95
    seen = model.transform(models._indexed(told).withColumn("class_weight", F.lit(1.0)))
    terms = next(s.vocabulary for s in model.stages if hasattr(s, "vocabulary"))
    train = [r["_terms"] for r in seen.filter(~held_out).select("_terms").collect()]
    first = seen.orderBy("doc_id").first()
    counts = {t: first["_terms"].count(t) for t in set(first["_terms"])}
    weights = {t: (1 + math.log(n)) * math.log((len(train) + 1) / (sum(t in d for d in train) + 1)) for t, n in counts.items() if t in terms}
    length = math.sqrt(sum(w * w for w in weights.values()))
    assert max(counts.values()) > 3
    assert {terms[i]: v for i, v in zip(first["_tfidf"].indices, first["_tfidf"].values) if v} == pytest.approx(
        {t: w / length for t, w in weights.items() if w})
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    plain = told.drop("label")
    score = lambda m: sorted(map(str, models.score_with_model(m, plain).collect()))
    assert score(again) == score(model)


def test_scores_follow_the_text(spark, told):
    """Labels, and the expected severity over 4: near its rank for each label, so swapped or constant classes fail."""
    model, _ = models.train_severity_model(told, key=["doc_id"], test=F.col("doc_id") % 5 == 0)
    out = models.score_with_model(model, told.filter("doc_id % 5 = 0")).withColumn("hit", F.lower("label") == F.col("predicted_label"))
    rows = {r["label"]: r for r in out.groupBy("label").agg(
        F.avg("model_score").alias("score"), F.avg(F.col("hit").cast("int")).alias("right"), F.min("model_confidence").alias("least")).collect()}
    assert all(r["right"] >= 0.95 and r["least"] > 1 / 3 for r in rows.values())
    assert rows["INFO"]["score"] < 0.2 and 0.35 < rows["MEDIUM"]["score"] < 0.65 and rows["CRITICAL"]["score"] > 0.8


def test_anomalies_are_the_far_rows(spark):
    """Twelve rows far from 588 others are the ones marked and score above all."""
    rows = [(i, float(i % 7), 20.0 + i % 11, 0.0, 0.1 + i % 3 / 100, 0.5) for i in range(588)]
    rows += [(1000 + i, 90.0 + i, 4000.0 + 50 * i, 1.0, 0.95, 0.05) for i in range(12)]
    frame = spark.createDataFrame(rows, "k int, ddos_score double, payload_length double, blocked double, ai_score double, ai_confidence double")
    out = models.score_anomalies(models.train_anomaly_model(frame, key=["k"]), frame)
    got = [(r["k"], r["is_anomaly"], r["anomaly_score"]) for r in out.collect()]
    far = [g for g in got if g[0] >= 1000]
    assert all(g[1] for g in far) and min(g[2] for g in far) > max(g[2] for g in got if g[0] < 1000)
    assert sum(bool(g[1]) for g in got) <= 24


def test_texts_are_read_twice(spark, told):
    """Once for the vocabulary and once for the counts; all later stages and the report work on what was kept."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = told.withColumn("text", F.udf(read, "string").asNondeterministic()("text"))
    _, report = models.train_severity_model(rows, key=["doc_id"], test=F.col("doc_id") % 5 == 0)
    assert report.agg(F.sum("support")).first()[0] == told.filter("doc_id % 5 = 0").count()
    assert seen.value <= 2 * told.count()

"""Pattern classifier: a multilayer perceptron on normalised windows.

There is no image network here: a window of 60 closes, highs and lows, scaled to its own range, is the classifier's
input instead of a rendered chart. Labels are made dense before training, so any set of pattern numbers can be learned.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlework.operators import labels


def chart(frame: DataFrame) -> DataFrame:
    """Adds features: closes, highs and lows of a window between its lowest low (0) and its highest high (1)."""
    low, high = F.array_min("w_l"), F.array_max("w_h")
    unit = lambda c: F.transform(c, lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.5))
    return frame.withColumn("features", array_to_vector(F.concat(unit("w_c"), unit("w_h"), unit("w_l"))))


def matrix(frame: DataFrame) -> DataFrame:
    """Adds chart, 60 rows of (open, high, low, close, volume) between 0 and 1: prices between the window's lowest low and
    highest high (0.5 if these are one), volumes over the largest (0 if there are none). It stands for a rendered image."""
    low, high, most = F.array_min("w_l"), F.array_max("w_h"), F.array_max("w_v")
    price = lambda x: F.when(high > low, (x - low) / (high - low)).otherwise(0.5)
    bars = F.arrays_zip("w_o", "w_h", "w_l", "w_c", "w_v")
    row = lambda b: F.array(*[price(b[c]) for c in ("w_o", "w_h", "w_l", "w_c")], F.when(most > 0, b["w_v"] / most).otherwise(0.0))
    return frame.withColumn("chart", F.transform(bars, row))


def train(rows: DataFrame, hidden: tuple[int, ...] = (32,), rounds: int = 30, seed: int = 7) -> PipelineModel:
    rows = chart(rows).select("features", F.col("pattern_id").cast("string").alias("pattern"))
    indexer = StringIndexer(inputCol="pattern", outputCol="label", handleInvalid="keep").fit(rows)
    net = MultilayerPerceptronClassifier(layers=[180, *hidden, len(indexer.labels) + 1], maxIter=rounds, seed=seed)
    return Pipeline(stages=[indexer, net]).fit(rows)


def probabilities(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Adds probs, an array of (p, pattern_id), the most probable first."""
    known = model.stages[0].labels
    out = model.transform(chart(rows).withColumn("pattern", F.col("pattern_id").cast("string") if "pattern_id" in rows.columns else F.lit("0")))
    p = vector_to_array("probability")
    pairs = F.array(*[F.struct(p[i].alias("p"), F.lit(int(name)).alias("pattern_id")) for i, name in enumerate(known)])
    return out.withColumn("probs", F.sort_array(pairs, False)).drop("features", "pattern", "label", "rawPrediction", "probability", "prediction")


def detect(model: PipelineModel, rows: DataFrame, least: float = 0.7, top: int = 3) -> DataFrame:
    """A row for each pattern among a window's top ones, without pattern 0, whose probability is least or more; with the
    pattern's name and the places of its start, end and breakout if the rows have start_idx."""
    carried = [c for c in (*rows.columns, "pattern", "end_idx", "breakout_idx") if c not in ("pattern_id", "confidence", "w_o", "w_h", "w_l", "w_c", "w_v")]
    found = probabilities(model, rows).drop("pattern_id", "confidence").withColumn("x", F.explode(F.slice("probs", 1, top)))
    found = found.withColumns({"pattern_id": F.col("x.pattern_id"), "confidence": F.col("x.p")}).where((F.col("pattern_id") != 0) & (F.col("confidence") >= least))
    if "start_idx" in rows.columns:
        found = labels.records(found)
    return found.select(*[c for c in carried if c in found.columns], "pattern_id", "confidence")


def backtest(model: PipelineModel, bars: DataFrame, least: float = 0.6, ahead: int = 20) -> DataFrame:
    """A row for each detection in the windows that are held back, with what came and whether the direction was right."""
    rows = labels.held_back(bars, ahead).select("ticker", "start_idx", "actual_return", "w_o", "w_h", "w_l", "w_c")
    return labels.judged(detect(model, rows, least))


def train_best(rows: DataFrame, valid: DataFrame, hidden: tuple[int, ...] = (32,), epochs: int = 6, rounds: int = 5, seed: int = 7) -> tuple[PipelineModel, list[dict]]:
    """The model with the smallest loss on valid rows, and the history: a record for each epoch of so many rounds.

    Each epoch goes on from the weights of the one before. Valid rows with labels that training has not seen count as wrong.
    """
    seen = chart(rows).select("features", F.col("pattern_id").cast("string").alias("pattern"))
    indexer = StringIndexer(inputCol="pattern", outputCol="label", handleInvalid="keep").fit(seen)
    ready = indexer.transform(seen)
    best, weights, history = None, None, []
    for epoch in range(epochs):
        net = MultilayerPerceptronClassifier(layers=[180, *hidden, len(indexer.labels) + 1], maxIter=rounds, seed=seed)
        if weights is not None:
            net.setInitialWeights(weights)
        fitted = net.fit(ready)
        weights = fitted.weights
        model = PipelineModel([indexer, fitted])
        own = F.try_element_at(F.filter("probs", lambda x: x["pattern_id"] == F.col("pattern_id")), F.lit(1))["p"]
        scored = probabilities(model, valid).select(F.greatest(F.coalesce(own, F.lit(0.0)), F.lit(1e-12)).alias("p"), (F.col("probs")[0]["pattern_id"] == F.col("pattern_id")).cast("double").alias("hit"))
        loss, accuracy = scored.agg(F.avg(-F.ln("p")), F.avg("hit")).first()
        history.append({"epoch": epoch, "train_loss": float(fitted.summary().objectiveHistory[-1]), "val_loss": loss, "val_acc": accuracy})
        if best is None or (loss is not None and loss < best[0]):
            best = (loss if loss is not None else float("inf"), model)
    return best[1], history


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def training_metadata(splits: DataFrame, tested: DataFrame, epochs: int, date: str) -> DataFrame:
    """One row, metadata: a JSON record of a training. splits has a split column; tested a column correct."""
    n = lambda name: F.count_if(F.col("split") == name)
    sizes = splits.agg(n("train").alias("training_samples"), n("valid").alias("validation_samples"), n("test").alias("test_samples"))
    share = tested.agg(F.avg(F.col("correct").cast("double"))).scalar()
    return sizes.select(F.to_json(F.struct(share.alias("test_accuracy"), "training_samples", "validation_samples", "test_samples", F.lit(epochs).alias("epochs"), F.lit(date).alias("training_date"))).alias("metadata"))

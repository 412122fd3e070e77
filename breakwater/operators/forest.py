"""Call classification by a random forest over evidence ratios."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from breakwater.functions.scalar import info_value

#: The class of a call whose best class is not likely enough.
UNKNOWN = "UKN"


@dataclass(frozen=True)
class Forest:
    """A fitted forest, its classes in order of their index, and each feature's importance."""

    model: RandomForestClassificationModel
    classes: list[str]

    @property
    def importances(self) -> list[float]:
        return [float(x) for x in self.model.featureImportances.toArray()]


def _indexed(rows: DataFrame, classes: list[str]) -> DataFrame:
    at = F.array_position(F.array(*map(F.lit, classes)), F.col("label")) - 1
    return rows.where("features IS NOT NULL AND label IS NOT NULL").select(array_to_vector(F.col("features").cast("array<double>")).alias("x"), at.cast("double").alias("y"))


def train_forest(rows: DataFrame, trees: int = 500, depth: int = 5, seed: int = 1) -> Forest:
    """Fit on ``features`` (an array of numbers) and ``label`` (a string); rows that lack one are left out. Classes are in text order."""
    classes = train_classes(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)
    return Forest(forest.fit(_indexed(rows, classes)), classes)


def cross_validate(rows: DataFrame, trees: int = 500, folds: int = 5, depth: int = 5, seed: int = 1) -> float:
    """Mean accuracy over the folds."""
    classes = train_classes(rows)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", numTrees=trees, maxDepth=depth, seed=seed)
    check = MulticlassClassificationEvaluator(labelCol="y", metricName="accuracy")
    cv = CrossValidator(estimator=forest, estimatorParamMaps=ParamGridBuilder().build(), evaluator=check, numFolds=folds, seed=seed)
    return float(cv.fit(_indexed(rows, classes)).avgMetrics[0])


def train_classes(rows: DataFrame) -> list[str]:
    return sorted(r.label for r in rows.select("label").where("label IS NOT NULL").distinct().collect())


def score_forest(rows: DataFrame, forest: Forest, least: float = 0.0) -> DataFrame:
    """Adds ``wc``, the likeliest class (``UKN`` below ``least``), and ``wp``, every class's probability in the order of the classes.

    Rows without features keep null in both.
    """
    width = forest.model.numFeatures
    known = F.when(F.size("features") == width, F.col("features")).otherwise(F.array_repeat(F.lit(0.0), width))
    out = forest.model.transform(rows.withColumn("x", array_to_vector(known.cast("array<double>"))))
    p = F.when(F.size("features") == width, vector_to_array("probability"))
    best = F.element_at(F.array(*map(F.lit, forest.classes)), (F.col("prediction") + 1).cast("int"))
    return out.withColumn("wp", p).withColumn("wc", F.when(F.col("wp").isNotNull(), F.when(F.array_max("wp") >= least, best).otherwise(F.lit(UNKNOWN)))).drop("x", "rawPrediction", "probability", "prediction")


def record_features(records: DataFrame) -> DataFrame:
    """Adds ``features``: the attributes (AT) of records but the first, as the training matrix has them; null where a record has none."""
    at = F.split(info_value(F.col("info"), "AT"), ",")
    return records.withColumn("features", F.transform(F.slice(at, 2, 1000), lambda x: x.try_cast("double")))


def annotated(scored: DataFrame) -> DataFrame:
    """Scored records with their class and all classes' probabilities at the end of INFO (``WC``, ``WP``)."""
    said = F.concat(F.lit(";WC="), "wc", F.lit(";WP="), F.array_join(F.transform("wp", lambda p: F.format_string("%.6g", p)), ","))
    return scored.withColumn("info", F.concat("info", F.coalesce(said, F.lit(""))))

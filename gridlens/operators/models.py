"""Training and applying Spark ML models: identify, disaggregate, presence, and both together."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, MultilayerPerceptronClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridlens.functions.draws import chance


def grouped_split(df: DataFrame, group: str, share: float, seed: int, draw: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) with whole groups on one side: groups whose hash falls into the share are the test.

    No order over all groups is needed. The group with the smallest hash is always in the test,
    and, of more than one, the group with the largest never is. Decided row by row: neither side is joined or
    moved, in however many passes it is read. ``draw``: a column with the groups' hash, if it is there already.
    """
    h = F.col(draw) if draw else chance(seed, group)
    ends = df.select(group, h.alias("_h")).distinct().agg(F.min(F.struct("_h", group)).alias("low"), F.max(F.struct("_h", group)).alias("high")).first()  # one row
    low, high = (ends["low"] or [None, None])[1], (ends["high"] or [None, None])[1]
    held = F.coalesce((F.col(group) == F.lit(low)) | ((h < share) & (F.col(group) != F.lit(high))), F.lit(False))
    return tuple(side.drop(*[draw] if draw else []) for side in (df.where(~held), df.where(held)))


def stratified_split(df: DataFrame, label: str, keys: Sequence[str], share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    """(train, test) by rows: about the same share of every label, by the hash of the row's keys.

    A label's share of test rows is exact where it has at most ``1 / share`` rows (one, or none of
    a single row); no task gathers a label's rows.
    """
    hashed = df.withColumn("_h", chance(seed, *keys))
    few = hashed.groupBy(label).agg(F.count("*").alias("_n"), F.min("_h").alias("_low"))
    ranked = hashed.join(few, label).withColumn("_r", F.when(F.col("_n") * share <= 1, F.when((F.col("_n") > 1) & (F.col("_h") == F.col("_low")), 0.0).otherwise(1.0)).otherwise(F.col("_h"))).drop("_h", "_n", "_low")
    return ranked.where(F.col("_r") >= share).drop("_r"), ranked.where(F.col("_r") < share).drop("_r")


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (classes * rows of the class), a handful of numbers: no row is joined or moved. Rows without a label are left out."""
    known = df.where(F.col(label).isNotNull())
    counts = {r[label]: r["count"] for r in known.groupBy(label).count().collect()}
    weights = [F.lit(x) for v, n in sorted(counts.items()) for x in (v, sum(counts.values()) / (len(counts) * n))]
    return known.withColumn(out, F.element_at(F.create_map(*weights), F.col(label)) if counts else F.lit(1.0))


def _prepared(columns: Sequence[str]) -> list:
    filled = [f"{c}_filled" for c in columns]
    return [
        Imputer(strategy="mean", inputCols=list(columns), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="raw_features", handleInvalid="keep"),
        StandardScaler(withMean=True, inputCol="raw_features", outputCol="features"),
    ]


def identify(df: DataFrame, columns: Sequence[str], label: str = "family", trees: int = 300, kind: str = "forest", seed: int = 5, rounds: int = 400) -> PipelineModel:
    """Family of a window: imputation, scaling and a balanced classifier: a forest of ``trees``, or one against the rest, boosted over ``rounds`` or linear."""
    weighted = balanced_weights(df, label)
    index = StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip")
    model = {
        "forest": lambda: RandomForestClassifier(numTrees=trees, weightCol="weight", seed=seed),
        "boosted": lambda: OneVsRest(classifier=GBTClassifier(maxIter=rounds, stepSize=0.05, seed=seed), weightCol="weight", parallelism=4),
        "svm": lambda: OneVsRest(classifier=LinearSVC(), weightCol="weight"),
    }[kind]()
    return Pipeline(stages=[*_prepared(columns), index, model]).fit(weighted)


def families_of(model: PipelineModel) -> list[str]:
    return next(list(s.labels) for s in model.stages if hasattr(s, "labels"))


def best_two(scored: DataFrame, names: Sequence[str], active: Column) -> DataFrame:
    """Best and second class with their probabilities; ``off`` for inactive windows."""
    p = vector_to_array("probability")
    ranked = F.sort_array(F.zip_with(F.array(*map(F.lit, names)), p, lambda f, x: F.struct((-x).alias("p"), f.alias("f"))))
    out = scored.withColumn("_r", ranked)
    at = lambda k, f: F.get("_r", F.lit(k))[f]
    return out.withColumns({"best": F.when(active, at(0, "f")).otherwise("off"), "p_best": -at(0, "p"), "second": at(1, "f"), "p_second": -at(1, "p")}).drop("_r")


class Families:
    """One model for each family over shared features; a family of one label only is a constant."""

    def __init__(self, models: dict[str, PipelineModel | float]):
        self.models = models

    @staticmethod
    def fit(df: DataFrame, columns: Sequence[str], families: Sequence[str], task: str, trees: int = 200, kind: str = "forest", seed: int = 5, parallel: int = 4, rounds: int = 300) -> Families:
        """``df`` has a column for each family: presence 0/1, or power. Forests of ``trees``; powers also boosted over ``rounds``."""
        prepared = Pipeline(stages=_prepared(columns)).fit(df)
        data = prepared.transform(df).select("features", *[f"`{f}`" for f in families]).cache()
        levels = data.agg(*[F.struct(F.min(f).cast("double").alias("a"), F.max(f).cast("double").alias("b")).alias(f) for f in families]).first()

        def one(f: str):
            if task == "presence":
                if levels[f] is None or levels[f]["a"] is None or levels[f]["a"] == levels[f]["b"]:
                    return f, float(levels[f]["a"] or 0.0) if levels[f] else 0.0
                est = RandomForestClassifier(numTrees=trees, labelCol=f, weightCol="_w", seed=seed)
                rows = balanced_weights(data, f, "_w")
            else:
                rows = data
                est = GBTRegressor(maxIter=rounds, stepSize=0.05, labelCol=f, seed=seed) if kind == "boosted" else RandomForestRegressor(numTrees=trees, labelCol=f, seed=seed)
            return f, PipelineModel([*prepared.stages, est.fit(rows)])

        with ThreadPoolExecutor(parallel) as jobs:
            models = dict(jobs.map(one, families))
        data.unpersist()
        return Families(models)

    def save(self, folder: str, spark: SparkSession) -> None:
        """A folder for each family's model; families of one label as a table of constants."""
        fitted = {f: m for f, m in self.models.items() if not isinstance(m, float)}
        for f, m in fitted.items():
            m.write().overwrite().save(f"{folder}/{f}")
        rows = [(f, None if f in fitted else m) for f, m in self.models.items()]
        spark.createDataFrame(rows, "family string, constant double").coalesce(1).write.mode("overwrite").parquet(f"{folder}/families")

    @staticmethod
    def load(folder: str, spark: SparkSession) -> Families:
        rows = spark.read.parquet(f"{folder}/families").collect()
        return Families({r["family"]: PipelineModel.load(f"{folder}/{r['family']}") if r["constant"] is None else r["constant"] for r in rows})

    def predict(self, df: DataFrame, out: str) -> DataFrame:
        """``<out>_<family>``: probability of presence, or power."""
        plain, ready = set(df.columns), None
        for f, m in self.models.items():
            if isinstance(m, float):
                df = df.withColumn(f"{out}_{f}", F.lit(m))
                plain.add(f"{out}_{f}")
                continue
            # Models that were fitted together prepare their features alike: once a row.
            prepared, model = PipelineModel(m.stages[:-1]), m.stages[-1]
            if (uids := [s.uid for s in prepared.stages]) != ready:
                df = prepared.transform(df.drop(*[c for c in df.columns if ready and c not in plain]))
                ready = uids
            before = set(df.columns)
            scored = model.transform(df)
            value = vector_to_array("probability")[1] if "probability" in scored.columns else F.col("prediction")
            df = scored.withColumn(f"{out}_{f}", value).drop(*[c for c in scored.columns if c not in before])
            plain.add(f"{out}_{f}")
        return df.drop(*[c for c in df.columns if ready and c not in plain])


def gated(df: DataFrame, families: Sequence[str], threshold: float = 0.5) -> DataFrame:
    """Power times predicted presence."""
    return df.withColumns({f"gated_{f}": F.col(f"power_{f}") * (F.col(f"presence_{f}") >= threshold).cast("int") for f in families})


def as_vectors(df: DataFrame, sequence: str) -> DataFrame:
    return df.withColumn("raw_features", array_to_vector(sequence))


def neural_presence(df: DataFrame, sequence: str, label: str, width: int, iterations: int = 120, seed: int = 5) -> PipelineModel:
    """Presence from raw sequences by a multilayer perceptron with layers of 256 and 128; apply to ``as_vectors`` rows."""
    rows = as_vectors(df, sequence)
    scale = StandardScaler(withMean=True, inputCol="raw_features", outputCol="features")
    net = MultilayerPerceptronClassifier(layers=[width, 256, 128, 2], maxIter=iterations, labelCol=label, seed=seed)
    return Pipeline(stages=[scale, net]).fit(rows)


def importance(model: PipelineModel, columns: Sequence[str]) -> list[tuple[str, float]]:
    """Features of a fitted forest by importance."""
    weights = model.stages[-1].featureImportances.toArray()
    return sorted(zip(columns, weights.tolist(), strict=True), key=lambda x: (-x[1], x[0]))

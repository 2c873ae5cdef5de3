"""A table of trained models: ``latest`` is replaced by retraining, ``original`` never."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlens.operators.models import Families, gated

SCHEMA = "name string, variant string, path string, features array<string>, families array<string>, metrics string, ts timestamp"


@dataclass(frozen=True)
class Mix:
    """Presence and power models of the same families."""

    presence: Families
    power: Families | None
    features: list[str]
    families: list[str]
    source: str

    def predict(self, df: DataFrame) -> DataFrame:
        """``presence_<family>``, and with power models ``power_<family>`` and ``gated_<family>``."""
        out = self.presence.predict(df, "presence")
        return gated(self.power.predict(out, "power"), self.families) if self.power else out


class ModelRegistry:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def entries(self) -> DataFrame:
        try:
            return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/registry")
        except Exception as e:  # no model was ever saved
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def save(self, name: str, model: PipelineModel | dict[str, Families], features: Sequence[str], families: Sequence[str], metrics: dict, variant: str = "latest") -> str:
        """Write the model (or families' models by part), then its registry row as the last step, so that a reader never sees half a model."""
        if variant == "original" and self.find(name, "original") is not None:
            raise ValueError(f"{name}: the original is frozen")
        n = self.entries().count()
        path = f"{self.folder}/{name}-{variant}-{n}"
        if isinstance(model, dict):
            for part, families_model in model.items():
                families_model.save(f"{path}/{part}", self.spark)
        else:
            model.write().overwrite().save(path)
        row = self.spark.createDataFrame([(name, variant, path, list(features), list(families), json.dumps(metrics, sort_keys=True))], SCHEMA.rsplit(",", 1)[0])
        row.withColumn("ts", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.folder}/registry")
        return path

    def find(self, name: str, variant: str = "latest"):
        """The newest row of a model; a missing ``latest`` falls back to ``original``."""
        rows = self.entries().where((F.col("name") == name) & (F.col("variant") == variant)).orderBy(F.desc("ts"), F.desc("path")).limit(1).collect()
        if rows:
            return rows[0]
        return self.find(name, "original") if variant == "latest" else None

    def mix(self, variant: str = "latest") -> Mix | None:
        """The mix model; without one, the presence model, with the power model if that knows the same families."""
        row = self.find("mix", variant)
        load = lambda r, part: Families.load(f"{r['path']}/{part}", self.spark)
        if row is not None:
            return Mix(load(row, "presence"), load(row, "power"), list(row["features"]), list(row["families"]), "mix")
        presence, power = self.find("presence", variant), self.find("power", variant)
        if presence is None:
            return None
        if power is None or list(power["families"]) != list(presence["families"]):
            return Mix(load(presence, "presence"), None, list(presence["features"]), list(presence["families"]), "presence")
        return Mix(load(presence, "presence"), load(power, "power"), list(presence["features"]), list(presence["families"]), "presence + power")

    def apply(self, name: str, df: DataFrame, variant: str = "latest") -> DataFrame:
        """Score with a stored model, features selected by name."""
        row = self.find(name, variant)
        if row is None:
            raise KeyError(name)
        missing = [c for c in row["features"] if c not in df.columns]
        if missing:
            raise ValueError(f"{name} needs {missing}")
        return PipelineModel.load(row["path"]).transform(df)

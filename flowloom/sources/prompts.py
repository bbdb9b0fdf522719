"""Prompt files: templates by label and name, with optional JSON sidecars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prompts import template_hash, version


def templates(spark: SparkSession, folder: str, suffix: str = ".j2") -> DataFrame:
    """name, label (null: flat), template, template_hash, version, of all files below folder."""
    root = folder.rstrip("/")
    raw = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", f"*{suffix}").text(root)
    path = F.regexp_replace(F.regexp_extract(F.col("_metadata.file_path"), rf"{root.split(':')[-1].rstrip('/')}/(.*)$", 1), rf"\{suffix}$", "")
    parts = F.split(path, "/")
    return raw.select(
        F.element_at(parts, -1).alias("name"), F.when(F.size(parts) > 1, F.element_at(parts, -2)).alias("label"), F.col("value").alias("template"),
        template_hash(F.col("value")).alias("template_hash"), version(F.col("value")).alias("version"),
    )


def sidecars(spark: SparkSession, folder: str) -> DataFrame:
    """name, label, config (JSON text) of all sidecars below folder."""
    t = templates(spark, folder, ".json")
    return t.select("name", "label", F.col("template").alias("config"))

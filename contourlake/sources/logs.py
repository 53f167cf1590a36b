"""Append-only logs of annotations, chat lines and storyboards, partitioned by project key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .structures import exists

KEY = "dataset string, project string, func string"
SCHEMAS = {
    "annotations": f"{KEY}, name string, s_id int, camera array<double>, pdb array<string>, ts string",
    "chat": f"{KEY}, seq long, line string",
    "storyboards": f"{KEY}, name string, ts string, annotations array<struct<name:string,s_id:int,ts:string>>",
}


def append_log(rows: DataFrame, root: str, kind: str) -> None:
    names = [c.strip().split()[0] for c in ("dataset", "project", "func")]
    rows.write.mode("append").partitionBy(*names).parquet(f"{root}/{kind}")


def read_log(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The log, or an empty table where nothing was ever written."""
    if not exists(spark, f"{root}/{kind}"):
        return spark.createDataFrame([], SCHEMAS[kind])
    return spark.read.schema(SCHEMAS[kind]).parquet(f"{root}/{kind}")


def chat_line(date, user, message):
    return F.format_string("[%s] %s > %s", date, user, message)


def board_title(name, ts):
    return F.format_string("%s [%s]", name, ts)

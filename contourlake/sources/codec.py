"""Rows as typed messages: a class name and a JSON payload, read back with the class's schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def encode_rows(rows: DataFrame, name: str) -> DataFrame:
    """class, payload; absent values stay absent."""
    return rows.select(F.lit(name).alias("class"), F.to_json(F.struct(*rows.columns)).alias("payload"))


def decode_rows(messages: DataFrame, name: str, schema: StructType) -> DataFrame:
    """The rows of one class; a payload that does not fit the schema raises when run."""
    own = messages.filter(F.col("class") == name)
    return own.select(F.from_json("payload", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def dispatch(messages: DataFrame, schemas: dict[str, StructType]) -> dict[str, DataFrame]:
    """The rows of every class by its schema; a message of a class that has none raises when any of them is run."""
    known = F.when(F.col("class").isin(*schemas), True).otherwise(F.raise_error(F.concat(F.lit("unknown class: "), F.coalesce("class", F.lit("null")))).cast("boolean"))
    checked = messages.filter(known)
    return {name: decode_rows(checked, name, schema) for name, schema in schemas.items()}

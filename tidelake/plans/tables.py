"""The driver's tables, and the views of them that stand for games, moves and players.

``moves``: the events of a user in order of id are a game's moves: game (user_id), ply (from 0), value, type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOVES = "m AS (SELECT user_id AS game, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ply, event_id, event_type AS type, value FROM events)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("game"), (F.row_number().over(w) - 1).alias("ply"), "event_id", F.col("event_type").alias("type"), "value")


def r6(c: Column) -> Column:
    """Rounded for comparison with another engine's order of additions."""
    return F.round(c, 6)

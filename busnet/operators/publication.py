"""Writing results: id lists, static documents and tiles, and the published version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from busnet.functions.tags import member_label
from busnet.operators import tiles


def id_lists(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """(kind, id) of everything that gets a document, ids as text."""
    return stops.select(F.lit("stop").alias("kind"), F.col("osm_id").cast("string").alias("id")).unionByName(
        routes.select(F.lit("route").alias("kind"), F.col("osm_id").cast("string").alias("id"))
    )


def document_keys(stops: DataFrame, routes: DataFrame) -> DataFrame:
    """(kind, key) of the static documents; stops are keyed by kind and id, so none is lost."""
    return stops.select(
        F.lit("stop").alias("kind"), member_label(F.col("osm_type"), F.col("osm_id")).alias("key")
    ).unionByName(
        routes.select(F.lit("route").alias("kind"), F.col("osm_id").cast("string").alias("key"))
    )


def write_id_lists(stops: DataFrame, routes: DataFrame, path: str) -> None:
    """path/kind=stop and path/kind=route, one id per line."""
    id_lists(stops, routes).write.mode("overwrite").partitionBy("kind").text(path)


_PER_FOLDER = 20_000


def write_documents(docs: DataFrame, keys: list[str], path: str, parts: int | None) -> None:
    """One JSON document per row, spread over `part` folders by a hash of the key."""
    parts = parts or -(-docs.count() // _PER_FOLDER) or 1
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")
    docs.withColumn("part", part).repartition("part").write.mode("overwrite").partitionBy("part").option(
        "ignoreNullFields", "false"
    ).json(path)


def store_tiles(payload: DataFrame, path: str) -> None:
    """Tiles as one table in the order of layer, zoom and a space-filling curve, so that an extent lies in few files."""
    order = ["layer", "z", "curve"]
    placed = payload.withColumn("curve", tiles.curve(F.col("x_tile"), F.col("y_tile")))
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def tiles_in(spark: SparkSession, path: str, layer: str, z: int, extent: tiles.Extent) -> DataFrame:
    """The stored tiles of one zoom of a layer that meet an extent; only row groups near it are read."""
    return spark.read.parquet(path).filter((F.col("layer") == layer) & tiles.in_extent(z, extent)).drop("curve")


def write_tiles(payload: DataFrame, path: str) -> None:
    payload.write.mode("overwrite").partitionBy("layer", "z").json(path)

"""Fusion of attributes from several sources, de-duplication, sampling and unions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: attribute names and their headers in an inventory
HEADERS = {
    "buildingheight": "BuildingHeight", "chimney": "ChimneyExists", "constype": "StructureType", "erabuilt": "YearBuilt", "garage": "GarageExists",
    "numstories": "NumberOfStories", "occupancy": "OccupancyClass", "repaircost": "ReplacementCost", "roofcover": "RoofCoverType",
    "roofeaveheight": "RoofEaveHeight", "roofshape": "RoofShape", "roofpitch": "RoofPitch", "winarea": "WindowAreaRatio",
}
# fixed values: the attributes that a loss model for earthquakes needs
LOSS_MODEL = ("constype", "erabuilt", "numstories", "occupancy", "repaircost")


def requested_attributes(request: str | Iterable[str]) -> list[str]:
    """Known attributes of a request: all, the loss model's, or a list; sorted, without unknown ones."""
    if isinstance(request, str):
        return {"all": sorted(HEADERS), "hazuseq": sorted(LOSS_MODEL)}.get(request.lower(), ["roofshape"])
    known = sorted({a.lower() for a in request} & set(HEADERS))
    if not known:
        raise ValueError("none of the requested attributes is known")
    return known


def fuse(base: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with values of ``source`` where these are neither null nor the text NA."""
    renamed = source.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    put = {c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("NA")) if dict(source.dtypes)[c] == "string" else F.col(f"__{c}"), F.col(c) if c in base.columns else F.lit(None)) for c in columns}
    return base.join(renamed, key, "left").withColumns(put).drop(*(f"__{c}" for c in columns))


def merge_predictions(inventory: DataFrame, predictions: DataFrame, image: str, column: str) -> DataFrame:
    """``column`` set to the prediction for the row's image, where there is one; of several, the likeliest counts."""
    best = predictions.where(F.col("image").isNotNull()).groupBy("image").agg(F.max_by("prediction", F.struct("probability", "prediction")).alias("__p"))
    joined = inventory.join(best.withColumnRenamed("image", image), image, "left")
    old = F.col(column) if column in inventory.columns else F.lit(None)
    return joined.withColumn(column, F.coalesce("__p", old)).drop("__p")


def keep_one(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first by ``order``, or the last. Aggregated before the shuffle."""
    values = [c for c in df.columns if c not in keys]
    pick = (F.max_by if last else F.min_by)(F.struct(*values), F.struct(*order)).alias("__v")
    return df.groupBy(*keys).agg(pick).select(*keys, *(F.col(f"__v.{c}").alias(c) for c in values))


def hash_order(key: str, seed: int):
    """A fixed shuffled order of integer keys that SQL engines agree on."""
    return F.pmod(F.col(key).cast("long") * 2654435761 + seed * 40503, F.lit(4294967291))


def sample(df: DataFrame, key: str, n: int | None, seed: int = 0) -> DataFrame:
    """``n`` rows of a shuffled order, or all; more than there are gives all."""
    return df if n is None else df.orderBy(hash_order(key, seed), key).limit(n)


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int = 0) -> DataFrame:
    order = Window.partitionBy(stratum).orderBy(hash_order(key, seed), key)
    return df.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= n).drop("__r")


def union_tagged(layers: dict[str, DataFrame], tag: str) -> DataFrame:
    """All layers under each other with their name in ``tag``; columns that a layer lacks are null."""
    out = None
    for name, df in layers.items():
        own = df.withColumn(tag, F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out

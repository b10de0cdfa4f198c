"""Where images were taken: folders of image files scanned, positions read from their headers.

All is done by functions on binary columns; of an image only its header is looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrastock.sources.readers import exif_position

# fixed values: marks of the segment that holds the data, and numbers of its fields
MARKER, SIGNATURE = b"\xff\xe1", b"Exif\x00\x00"
GPS, LAT_REF, LAT, LON_REF, LON, DIRECTION = 0x8825, 1, 2, 3, 4, 17
#: Segments of a file that are searched; the standard wants the one with the data first or second.
SEGMENTS = 32


def image_files(spark: SparkSession, path: str, extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp")) -> DataFrame:
    """(path, length, content) of the files below a folder that have one of the extensions, in any case. Spark's scan leaves
    out files without a byte."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.where(F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*extensions)).select("path", "length", "content")


def _number(content: Column, at: Column, size: int, little: Column | bool = False) -> Column:
    """The unsigned number of ``size`` bytes at a place from 0; null beyond the end."""
    held = F.hex(F.substring(content, at.cast("int") + 1, F.lit(size)))
    turned = F.regexp_replace(F.reverse(held), "(.)(.)", "$2$1")
    order = held if little is False else F.when(little, turned).otherwise(held)
    return F.when(at + size <= F.octet_length(content), F.conv(order, 16, 10).cast("long"))


def _bytes_at(content: Column, at: Column, size: int) -> Column:
    return F.substring(content, at.cast("int") + 1, F.lit(size))


def _field(content: Column, table: Column, tag: int, little: Column) -> Column:
    """The place of a table's field with a number, null if it has none."""
    n = _number(content, table, 2, little)
    places = F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: table + 2 + 12 * i))
    return F.get(F.filter(places, lambda e: _number(content, e, 2, little) == tag), F.lit(0))


def header_positions(images: DataFrame, image: str = "path", content: str = "content") -> DataFrame:
    """(image, lat, lon, heading) from the headers of images: degrees, negative in the south and west.

    Null where an image has no such header, or lacks the field, or its header is cut off or has a denominator of 0.
    """
    c = F.col("__c")
    found = lambda at: (_bytes_at(c, at, 2) == F.lit(MARKER)) & (_bytes_at(c, at + 4, 6) == F.lit(SIGNATURE))
    onward = lambda at: F.when(_number(c, at, 1) == 255, at + 2 + _number(c, at + 2, 2))
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(SEGMENTS)), F.lit(2).cast("long"), lambda at, _: F.when(found(at), at).otherwise(onward(at)))
    rows = images.select(F.col(image).alias("image"), F.col(content).alias("__c")).withColumn("__at", walked)
    # places in the header count from its first byte
    rows = rows.withColumn("__t", F.when(found(F.col("__at")), F.col("__at") + 10)).withColumn("__little", _bytes_at(c, F.col("__t"), 2) == F.lit(b"II"))
    little, start = F.col("__little"), F.col("__t")
    at_value = lambda e: start + _number(c, F.col(e) + 8, 4, little)
    # one step at a time, so that each is a column and no expression holds copies of those before it
    rows = rows.withColumn("__first", start + _number(c, start + 4, 4, little)).withColumn("__e", _field(c, F.col("__first"), GPS, little)).withColumn("__gps", at_value("__e"))
    tags = (LAT_REF, LAT, LON_REF, LON, DIRECTION)
    rows = rows.withColumns({f"__f{tag}": _field(c, F.col("__gps"), tag, little) for tag in tags})
    rows = rows.withColumns({f"__v{tag}": at_value(f"__f{tag}") for tag in (LAT, LON, DIRECTION)})

    def ratio(tag: int, k: int = 0) -> Column:
        at = F.col(f"__v{tag}") + 8 * k
        return _number(c, at, 4, little) / F.nullif(_number(c, at + 4, 4, little), F.lit(0).cast("long"))

    side = lambda tag: F.upper(_bytes_at(c, F.col(f"__f{tag}") + 8, 1).cast("string"))
    parts = {f"{name}_{p}": ratio(tag, k) for name, tag in (("lat", LAT), ("lon", LON)) for k, p in enumerate("dms")}
    told = rows.select("image", *(v.alias(k) for k, v in parts.items()), side(LAT_REF).alias("lat_ref"), side(LON_REF).alias("lon_ref"), ratio(DIRECTION).alias("heading"))
    return exif_position(told)


def read_image_positions(spark: SparkSession, path: str) -> DataFrame:
    """(image, lat, lon, heading) of the photographs below a folder."""
    return header_positions(image_files(spark, path, ("jpg", "jpeg")))

"""Table layouts shared by every operator, and helpers that bring inputs to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

BBOX = T.StructType([T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2")])
BBOX_DDL = "struct<x1:double,y1:double,x2:double,y2:double>"

# One token as stored in a cache file: bbox is a four-number list there.
TOKEN_JSON = T.StructType([
    T.StructField("text", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("bbox", T.ArrayType(T.DoubleType())),
    T.StructField("extras", T.MapType(T.StringType(), T.StringType())),
    T.StructField("detection_confidence", T.DoubleType()),
])
TOKEN_CACHE = T.StructType([
    T.StructField("image_id", T.StringType()),
    T.StructField("tokens", T.ArrayType(TOKEN_JSON)),
])

TOKEN_COLUMNS = ["image_id", "token_index", "text", "confidence", "detection_confidence",
                 "bbox", "source", "extras"]

LABEL_COLUMNS = ["image_id", "year", "month", "day", "final_date"]

BOX = T.StructType([
    T.StructField("class", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("cx", T.DoubleType()),
    T.StructField("cy", T.DoubleType()),
    T.StructField("width", T.DoubleType()),
    T.StructField("height", T.DoubleType()),
])
BOX_MANIFEST = T.StructType([
    T.StructField("dataset", T.StringType()),
    T.StructField("classes", T.ArrayType(T.StringType())),
    T.StructField("records", T.ArrayType(T.StructType([
        T.StructField("image_id", T.StringType()),
        T.StructField("image", T.StringType()),
        T.StructField("crc", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("boxes", T.ArrayType(BOX)),
    ]))),
])

DETECTOR_PREDICTIONS = T.StructType([
    T.StructField("predictions", T.ArrayType(T.StructType([
        T.StructField("image_id", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("candidates", T.ArrayType(T.StructType([
            T.StructField("raw", T.StringType()),
            T.StructField("prediction", T.StringType()),
            T.StructField("rec_score", T.DoubleType()),
            T.StructField("det_conf", T.DoubleType()),
            T.StructField("class", T.IntegerType()),
            T.StructField("bbox", T.ArrayType(T.DoubleType())),
        ]))),
    ]))),
])

# A position inside an image is cut into tiles of this many tokens. An ordinary image is one
# tile; an image that holds a large share of all rows becomes many equal, independent pieces,
# so joins keyed by (image, tile) never gather it in one task.
TILE_TOKENS = 4096

# Candidate ordinals leave room for this many candidates per token or text line.
ORDINAL_STRIDE = 1 << 20


def as_tokens(df: DataFrame) -> DataFrame:
    """Project any token table to the standard columns, filling the optional ones."""
    have = set(df.columns)
    extras = F.col("extras") if "extras" in have else F.lit(None).cast("map<string,string>")
    return df.select(
        F.col("image_id").cast("string").alias("image_id"),
        F.col("token_index").cast("int").alias("token_index"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
        (F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)) if "confidence" in have
         else F.lit(0.0)).alias("confidence"),
        (F.col("detection_confidence").cast("double") if "detection_confidence" in have
         else F.lit(None).cast("double")).alias("detection_confidence"),
        (F.col("bbox") if "bbox" in have else F.lit(None).cast(BBOX_DDL)).alias("bbox"),
        (F.col("source").cast("string") if "source" in have
         else F.try_element_at(extras, F.lit("source"))).alias("source"),
        extras.alias("extras"),
    )


def tile_of(token_index):
    return F.floor(token_index / F.lit(TILE_TOKENS)).cast("int")

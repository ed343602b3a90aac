"""Table layouts shared by sources and operators."""

from pyspark.sql import types as T

BBOX = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("xmin", "ymin", "xmax", "ymax")]
)

SENSOR_BANDS = T.StructType(
    [
        T.StructField("platform", T.StringType(), False),
        T.StructField("band_idx", T.IntegerType(), False),
        T.StructField("band", T.StringType(), False),
        T.StructField("mean", T.DoubleType(), False),
        T.StructField("std", T.DoubleType(), False),
        T.StructField("wavelength_um", T.DoubleType(), False),
        T.StructField("gsd", T.DoubleType(), False),
        T.StructField("rgb_pos", T.IntegerType()),
    ]
)

SCENES = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("collection", T.StringType()),
        T.StructField("tile", T.StringType()),
        T.StructField("dt", T.TimestampType()),
        T.StructField("cloud_cover", T.DoubleType()),
        T.StructField("epsg", T.IntegerType()),
        T.StructField("bbox", BBOX),
    ]
)

# Pixels are band -> row-major H*W, so a band is one contiguous array.
CHIPS = T.StructType(
    [
        T.StructField("chip_id", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("item_id", T.StringType()),
        T.StructField("chip_x", T.IntegerType()),
        T.StructField("chip_y", T.IntegerType()),
        T.StructField("dt", T.TimestampType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("h", T.IntegerType()),
        T.StructField("w", T.IntegerType()),
        T.StructField("bands", T.ArrayType(T.StringType())),
        T.StructField("pixels", T.ArrayType(T.ArrayType(T.FloatType()))),
    ]
)

PATCHES = T.StructType(
    [
        T.StructField("chip_id", T.StringType()),
        T.StructField("patch_row", T.IntegerType()),
        T.StructField("patch_col", T.IntegerType()),
        T.StructField("patch_idx", T.IntegerType()),
        T.StructField("masked", T.IntegerType()),
        T.StructField("vals", T.ArrayType(T.FloatType())),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("item_id", T.StringType()),
        T.StructField("chip_x", T.IntegerType()),
        T.StructField("chip_y", T.IntegerType()),
        T.StructField("dt", T.TimestampType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
        T.StructField("bbox", BBOX),
        T.StructField("cloud_cover", T.DoubleType()),
    ]
)

POINTS = T.StructType(
    [
        T.StructField("point_id", T.LongType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("class", T.IntegerType()),
    ]
)

METRIC_LOG = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("phase", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("epoch", T.IntegerType()),
        T.StructField("step", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

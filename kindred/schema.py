"""Default column names and the schemas of the relations passed between operators."""

from pyspark.sql import types as T

GROUP = "motion_id"
CAPTION = "caption_id"
LINE = "line_no"
TEXT = "description"
TAGS = "pos_tags"
SIM = "mean_intra_caption_sim"
SIZE = "num_captions"

PARSED_TYPE = T.ArrayType(
    T.StructType([T.StructField("tok", T.StringType()), T.StructField("pos", T.StringType())])
)

CAPTIONS = T.StructType(
    [
        T.StructField(GROUP, T.StringType(), False),
        T.StructField(CAPTION, T.StringType()),
        T.StructField(LINE, T.IntegerType()),
        T.StructField(TEXT, T.StringType()),
        T.StructField(TAGS, T.StringType()),
        T.StructField("num1", T.DoubleType()),
        T.StructField("num2", T.DoubleType()),
    ]
)

VECTORS = T.StructType(
    [
        T.StructField(GROUP, T.StringType(), False),
        T.StructField(CAPTION, T.StringType()),
        T.StructField("vec", T.ArrayType(T.FloatType())),
    ]
)


def frames(element: str = "float") -> str:
    """Per-frame rows of an array file; every row repeats the file's shape."""
    return f"{GROUP} string, ndim int, n_frames bigint, frame int, vec array<{element}>"

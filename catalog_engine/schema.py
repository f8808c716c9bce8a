"""Declared schemas of the catalogue layers."""

from pyspark.sql import types as T

# Raw layer: every column is text, exactly as scraped.
RAW = T.StructType(
    [
        T.StructField(c, T.StringType())
        for c in (
            "url",
            "name",
            "gender",
            "rating",
            "rating_count",
            "main_accords",
            "perfumers",
            "description",
        )
    ]
)

CLEAN = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("brand", T.StringType()),
        T.StructField("release_year", T.StringType()),
        T.StructField("accords", T.StringType()),
        T.StructField("top_notes", T.StringType()),
        T.StructField("mid_notes", T.StringType()),
        T.StructField("base_notes", T.StringType()),
        T.StructField("perfumers", T.StringType()),
        T.StructField("gender", T.StringType()),
        T.StructField("rating_count", T.IntegerType()),
        T.StructField("rating", T.DecimalType(10, 2)),
        T.StructField("description", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("perfume_string", T.StringType()),
    ]
)

EMBEDDINGS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("perfume_string", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

"""File sources: delimited training data, JSON artifacts, replay fixtures, event and job-envelope ingest.

Readers take explicit schemas (no inference in production), keep malformed
records in a ``_corrupt_record`` column instead of dropping them, and return
DataFrames; the ``*_stream`` variants return streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAKAGE_COLUMN = "duration"


class SchemaError(ValueError):
    pass


def read_training(spark: SparkSession, path: str, target_column: str, schema: T.StructType | None = None,
                  sep: str = ";", leakage_column: str = LEAKAGE_COLUMN) -> DataFrame:
    """Delimited training file with a header; the target and the leakage column must be present."""
    reader = spark.read.option("header", True).option("sep", sep)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    if target_column not in df.columns:
        raise SchemaError(f"Target column '{target_column}' not found in {path}.")
    if leakage_column and leakage_column not in df.columns:
        raise SchemaError(f"Expected column '{leakage_column}' was not found. It must be dropped to avoid label "
                          "leakage.")
    return df


def read_json_artifact(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = True) -> DataFrame:
    """JSON document(s) with a known schema; a missing path gives an empty DataFrame of that schema."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


FIXTURE_ARRAYS = T.StructType([
    T.StructField("description", T.StringType()),
    T.StructField("selected_threshold", T.DoubleType()),
    T.StructField("rows", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    T.StructField("expected_probabilities", T.ArrayType(T.DoubleType())),
    T.StructField("expected_predictions", T.ArrayType(T.IntegerType())),
    T.StructField("actual_classes", T.ArrayType(T.IntegerType())),
])
FIXTURE_SCHEMA = T.StructType(FIXTURE_ARRAYS.fields + [T.StructField("fixture", FIXTURE_ARRAYS)])


def read_replay_fixture(spark: SparkSession, path: str) -> DataFrame:
    """Replay fixture documents, bare or wrapped under ``fixture``, as one row per fixture row."""
    from vigil.operators.replay import fixture_rows
    doc = read_json_artifact(spark, path, FIXTURE_SCHEMA)
    return fixture_rows(doc)


def _with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType(schema.fields + [T.StructField("_corrupt_record", T.StringType())])


def ingest_json_lines(df_text: DataFrame, schema: T.StructType, value_col: str = "value") -> DataFrame:
    """Parse JSON text lines with ``from_json`` (PERMISSIVE): ``parsed`` plus ``malformed`` for unparsable lines.

    A line that is not JSON, or has a field of another type than the schema's, keeps its text and is routed to a
    reject output by the caller, never lost.
    """
    out = df_text.withColumn("parsed", F.from_json(F.col(value_col), _with_corrupt(schema), {
        "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    corrupt = F.col("parsed._corrupt_record").isNotNull()
    # a non-JSON line parses to a struct of nulls; so does '{}' — both are rejected
    all_null = F.aggregate(F.array(*[F.col(f"parsed.{f.name}").isNull() for f in schema.fields]), F.lit(True),
                           lambda a, x: a & x)
    out = out.withColumn("malformed", F.col("parsed").isNull() | all_null | corrupt)
    return out.withColumn("parsed", F.col("parsed").dropFields("_corrupt_record"))


def read_text_stream(spark: SparkSession, path: str, glob: str | None = None, max_files: int | None = None
                     ) -> DataFrame:
    r = spark.readStream.format("text")
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.load(path)

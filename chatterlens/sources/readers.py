"""JSON files and message topics in, JSON files and messages out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from chatterlens import schemas

Schema = str | StructType


def json_document(spark: SparkSession, path: str, schema: Schema = schemas.SOURCE_FILE) -> DataFrame:
    """A JSON file holding an array of entries, one entry, or an object whose
    ``results`` is the array. Several such files may be read at once."""
    entry = schema["results"].dataType.elementType
    both = StructType([*schema.fields, *entry.fields])
    rows = spark.read.schema(both).json(path, multiLine=True)
    plain = F.struct(*[F.col(f.name) for f in entry.fields])
    entries = F.when(F.col("results").isNotNull(), F.col("results")).otherwise(F.array(plain))
    return rows.select(F.inline(entries))


def json_lines(spark: SparkSession, path: str, schema: Schema) -> DataFrame:
    """One object per line; blank lines are skipped, malformed ones become NULL rows."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def write_json(df: DataFrame, path: str, compression: str | None = None) -> None:
    df.write.mode("overwrite").option("compression", compression or "none").json(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def to_driver(df: DataFrame, limit: int = 1000, *order: str | Column):
    """The first rows as pandas, for display: by ``order``, else by all columns
    that can be ordered, so that equal data shows equal rows."""
    by = order or [f.name for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    return (df.orderBy(*by) if by else df).limit(limit).toPandas()


# --- messages ---------------------------------------------------------------

def as_messages(df: DataFrame, key: str | None = None) -> DataFrame:
    value = F.to_json(F.struct("*")).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def topic_write_options(servers: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers, "topic": topic,
        "kafka.acks": "all", "kafka.compression.type": "gzip",
    }


def publish(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    writer = as_messages(df, key).write.format("kafka")
    writer.options(**topic_write_options(servers, topic)).save()


def topic_read_options(
    servers: str, topic: str, start: str = "earliest", max_per_batch: int | None = None, lossy: bool = False,
) -> dict[str, str]:
    """Offsets that are gone stop the stream, unless the caller accepts the loss (``lossy``)."""
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": start,
        "failOnDataLoss": "false" if lossy else "true",
    }
    return {**options, "maxOffsetsPerTrigger": str(max_per_batch)} if max_per_batch else options


def subscribe(spark: SparkSession, servers: str, topic: str, **options) -> DataFrame:
    reader = spark.readStream.format("kafka")
    return reader.options(**topic_read_options(servers, topic, **options)).load()


def parsed(messages: DataFrame, schema: Schema = schemas.STREAM_MESSAGE, value: str | Column = "value") -> DataFrame:
    """The message fields plus ``raw``; ``is_bad`` marks text that is not an object of the schema."""
    fields = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    text = (value if isinstance(value, Column) else F.col(value)).cast("string")
    marked = StructType([*fields.fields]).add("_corrupt", "string")
    body = F.from_json(text, marked, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return messages.select(text.alias("raw"), body.alias("body")).select(
        "raw", (F.col("body").isNull() | F.col("body._corrupt").isNotNull()).alias("is_bad"),
        *[F.col(f"body.{f.name}").alias(f.name) for f in fields],
    )


def good(messages: DataFrame) -> DataFrame:
    return messages.filter(~F.col("is_bad")).drop("is_bad", "raw")


def quarantined(messages: DataFrame) -> DataFrame:
    return messages.filter("is_bad").select("raw")

"""Dead letters: enrichment, storage, summary, alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "failed_at_utc timestamp, original_topic string, error_code string, error_message string, schema_id int, raw_payload_b64 string, raw_payload_len int, context string"


def letters(df: DataFrame, topic: str, code: str, message: str, payload: str, schema_id: str = "schema_id") -> DataFrame:
    """Rows as dead letters."""
    return df.select(
        F.current_timestamp().alias("failed_at_utc"), F.lit(topic).alias("original_topic"), F.col(code).alias("error_code"), F.substring(F.col(message), 1, 500).alias("error_message"), F.col(schema_id).cast("int").alias("schema_id"),
        F.base64(F.col(payload)).alias("raw_payload_b64"), F.length(F.col(payload)).alias("raw_payload_len"), F.lit(None).cast("string").alias("context"),
    )


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Stored letters; lines that are no JSON give nulls, blank ones nothing."""
    return spark.read.schema(SCHEMA).option("mode", "PERMISSIVE").json(path)


def summary(df: DataFrame) -> DataFrame:
    return df.groupBy(F.coalesce("error_code", F.lit("UNKNOWN")).alias("error_code")).agg(F.count(F.lit(1)).alias("n"))


def alerts(df: DataFrame) -> DataFrame:
    """Payloads for a webhook as JSON text; nothing is sent."""
    field = lambda n, c: F.struct(F.lit(n).alias("name"), c.alias("value"))
    fields = F.array(field("Topic", F.col("original_topic")), field("Error", F.col("error_code")), field("Schema", F.coalesce(F.col("schema_id").cast("string"), F.lit("N/A"))), field("Bytes", F.col("raw_payload_len").cast("string")))
    embed = F.struct(F.lit("Dead letter").alias("title"), F.col("error_message").alias("description"), F.lit(15158332).alias("color"), fields.alias("fields"))
    return df.select(F.to_json(F.struct(F.array(embed).alias("embeds"))).alias("payload"))

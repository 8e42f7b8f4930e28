"""Sources and sinks, and the transfer and account views over the event table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.schema import KINDS


def read_stage(spark: SparkSession, path: str, schema=None, made_by: str = "an earlier stage") -> DataFrame:
    """A stage's Parquet table; a missing one is named together with the stage that makes it."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            raise FileNotFoundError(f"{path} does not exist: run {made_by} first") from e
        raise


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def json_document(df: DataFrame, order: str) -> DataFrame:
    """The rows as one JSON array (for bounded results such as an alert list)."""
    packed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*df.columns).alias("row"))))
    return df.agg(F.to_json(packed["row"], {"ignoreNullFields": "false", "pretty": "true"}).alias("json"))


def transfers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as transfers in integer money; self-transfers go."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    n = e.agg(F.countDistinct("user_id").alias("n"))
    t = e.crossJoin(F.broadcast(n)).select(  # one row
        F.col("event_id").alias("txn_id"), F.expr("timestampdiff(MINUTE, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)").alias("minute"), F.col("user_id").alias("sender"),
        F.pmod(F.col("user_id") * 31 + F.col("event_id") * 7 + 1, F.col("n")).alias("receiver"), F.round(F.col("value") * 1000).cast("long").alias("amount"),
        F.when(F.col("event_type") == "signup", "P2M").otherwise("P2P").alias("channel"),
    )
    return t.where("sender <> receiver")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id")
    ids = e.where("user_id is not null").distinct()
    n = e.agg(F.countDistinct("user_id").alias("n"))
    kind = F.element_at(F.lit(list(KINDS)), (F.col("user_id") % 11 + 1).cast("int"))
    mule = (F.col("user_id") % 11).isin(1, 10)
    net = F.concat(F.lit("NET"), (F.col("user_id") % 5).cast("string"))
    nets = F.when(F.col("user_id") % 4 == 0, F.concat_ws("|", net, F.concat(F.lit("NET"), ((F.col("user_id") + 3) % 5).cast("string")))).otherwise(net)
    return ids.crossJoin(F.broadcast(n)).select(  # one row
        F.col("user_id").alias("account_id"), kind.alias("account_type"), (-(F.col("user_id") * 37 % 2500)).cast("int").alias("open_day"), (F.col("user_id") % F.greatest(F.lit(1), F.floor(F.col("n") / 3))).cast("long").alias("device_id"),
        mule.cast("int").alias("is_mule"), (F.col("user_id") % 11 == 1).cast("int").alias("is_exit"), (mule & (F.col("user_id") % 7 == 0)).cast("int").alias("label_exposed"), F.when(mule, nets).otherwise("").alias("mule_network_id"),
    )

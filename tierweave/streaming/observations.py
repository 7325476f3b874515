"""Vendor facts from a stream of DNS answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierweave.operators.txt import extract_txt
from tierweave.sources.readers import TABLES


def read_answers(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of Parquet files of DNS answers with the time they were seen."""
    return spark.readStream.schema(TABLES["dns_answers"] + ", seen timestamp").option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def vendor_facts(answers: DataFrame, late: str = "1 hour") -> DataFrame:
    """Different facts of TXT answers; one that comes again within ``late`` is left out, the state before that goes."""
    facts = extract_txt(answers.where("rrtype = 'TXT'")).select("name", "domain", "source_type", "raw_record", "seen")
    return facts.withWatermark("seen", late).dropDuplicatesWithinWatermark(["name", "domain", "source_type", "raw_record"])


def counts(facts: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Facts per window and source type."""
    return facts.withWatermark("seen", late).groupBy(F.window("seen", window), "source_type").agg(F.count("*").alias("n"))


def write_facts(facts: DataFrame, path: str, checkpoint: str):
    """Start writing facts as Parquet, exactly once per input file."""
    return facts.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").start()

"""Cleaning of pages as they arrive; the rules are stateless, so a stream needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagewright.operators.cleaning import clean_text, is_toc


def clean_stream(spark: SparkSession, folder: str, schema: str = "doc_id string, page_number int, raw_text string, loaded_at timestamp") -> DataFrame:
    """A streaming frame of cleaned pages from Parquet files that are dropped into a folder."""
    pages = spark.readStream.schema(schema).parquet(folder)
    return pages.withColumn("text", clean_text("raw_text")).withColumn("is_toc", is_toc("raw_text"))

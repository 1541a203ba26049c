"""The providers that calls are made to, with their caps: a dimension of two rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed: name, base URL, calls allowed and the seconds they are counted in.
PROVIDERS = [("groq", "https://api.groq.com/openai/v1", 25, 60.0), ("openrouter", "https://openrouter.ai/api/v1", 18, 60.0)]


def providers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PROVIDERS, "provider string, base_url string, max_calls int, period_seconds double")

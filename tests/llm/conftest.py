import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """{key: text} → table of documents with columns whose names clash with what operators add."""

    def build(rows, clash: bool = False):
        rows = list(rows.items()) if isinstance(rows, dict) else list(rows)
        df = spark.createDataFrame(rows, "series_id bigint, text string")
        if clash:
            from pyspark.sql import functions as F

            df = df.withColumns({c: F.lit(7) for c in ("key", "kept", "shard", "slot", "row", "n_words", "score", "n_chars", "ids", "start", "_hash", "word_chars")})
        return df

    return build

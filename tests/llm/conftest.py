import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A documents table of (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with derived ones."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        from pyspark.sql import functions as F

        extra = ("size", "key", "rep", "score", "found", "bucket", "component", "original", "words", "_size", "_t")
        return df.select("*", *[F.lit("clash").alias(n) for n in extra])

    return make


@pytest.fixture
def labels(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int")

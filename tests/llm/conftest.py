import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents-like table of (doc_id, text[, source]); more columns clash with working names."""

    def make(rows, extra=False):
        rows = [(*r, *(["s"] if len(r) == 2 else [])) for r in rows]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string")
        if extra:
            from pyspark.sql import functions as F

            for c in ("hits", "_hits", "_host", "_bad", "_lines", "_rid", "n", "fp", "node", "held_out", "score", "predicted", "h", "sid", "starts"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make

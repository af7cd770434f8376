import pytest
from pyspark.sql import types as T


@pytest.fixture
def docs(spark):
    """docs([(id, text), ...]) as documents with a clashing extra column."""
    def make(rows, extra="score"):
        schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                               T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                               T.StructField("n_chars", T.LongType()), T.StructField(extra, T.StringType())])
        rows = [tuple(r) + (None,) * (6 - len(r)) for r in rows]
        return spark.createDataFrame(rows, schema).repartition(3)
    return make

import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Builds a documents table of (doc_id, text) rows."""

    def make(rows, extra: bool = False):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'x' as key", "1 as id", "'y' as candidates", "0 as component_id", "array(1) as bands") if extra else df

    return make


@pytest.fixture(scope="session")
def corpus(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")

import re

import pytest

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Names of columns that operators use inside; as extra columns they must not disturb them.
CLASHING = ("id", "key", "node", "row", "size", "words", "digest", "block", "n", "label", "salt", "place", "taken")


@pytest.fixture
def table(spark, tmp_path):
    """Write rows as a table with extra columns of clashing names and read it back."""

    def make(rows, schema="doc_id long, text string", extra=CLASHING, name="t"):
        df = spark.createDataFrame(rows, schema)
        for column in extra:
            if column not in df.columns:
                df = df.selectExpr("*", f"'x' AS `{column}`")
        path = str(tmp_path / name)
        df.coalesce(1).write.parquet(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def words():
    return lambda text: WORDS.findall(text or "")

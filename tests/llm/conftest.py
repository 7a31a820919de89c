import pytest


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text, source) rows, with a column that clashes with names used inside the operators."""

    def made(rows):
        full = [(*r, None)[:3] if len(r) < 3 else r for r in rows]
        return spark.createDataFrame([(*r[:3], "x") for r in full], "doc_id long, text string, source string, size string")

    return made

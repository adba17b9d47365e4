import pytest


@pytest.fixture
def documents(spark):
    """Build a documents table from (doc_id, text) or (doc_id, text, lang), with clashing extra columns."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", 0, 1, "x", 2) for r in rows]
        return spark.createDataFrame(
            full,
            "doc_id long, text string, lang string, source string, n_chars long, token int, class string, words int",
        ).withColumnRenamed("words", "row")

    return build

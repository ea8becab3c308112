import pytest

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def documents(spark):
    """Documents from (doc_id, text[, lang, source]) rows."""

    def make(rows, extra=()):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, *[None] * (4 - len(r)))[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text)))
        df = spark.createDataFrame(full, DOCUMENTS)
        for name in extra:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("kept"))
        return df

    return make

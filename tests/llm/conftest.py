import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """documents(rows of (doc_id, text[, lang])): a table with columns whose names operators use themselves."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOC).repartition(3)
        for c in ("id", "key", "hub", "d", "t", "start", "size", "shard", "slot", "lang_pred", "score", "kept_text", "o0", "rank", "ids", "count", "n"):
            df = df.withColumn(c, df["source"])
        return df

    return make

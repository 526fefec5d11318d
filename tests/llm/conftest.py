import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, h long, shard int, spans string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with the operators' own."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", f"s{n % 3}", None if t is None else len(t), 7, 8, 9, "x") for n, (i, t) in enumerate(rows)], SCHEMA).repartition(3)

    return make


EDGE = [(0, "a b c d e f"), (1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "x y z"), (4, "word " * 30_000), (5, " \t\n "), (6, "é ß 日本 😀 ▁ \\ </s>")]

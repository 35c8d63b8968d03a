import pytest


@pytest.fixture
def docs(spark):
    """Documents from texts; doc_ids count from 0, other columns as given."""

    def make(*texts, **columns):
        names = ["doc_id", "text", *columns]
        rows = [(i, t, *(columns[c][i] for c in columns)) for i, t in enumerate(texts)]
        kinds = {c: "int" if all(isinstance(x, int) for x in v) else "string" for c, v in columns.items()}
        schema = ", ".join(["doc_id long", "text string", *(f"{c} {kinds[c]}" for c in columns)])
        assert names
        return spark.createDataFrame(rows, schema)

    return make

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def clash():
    """Adds columns whose names operators use for results of their own."""

    def add(df):
        return df.withColumns({c: F.lit("x") for c in ("score", "rank", "length", "kept", "bucket", "_h", "n", "w", "h", "item_id2", "_bucket", "lang_pred", "held_out", "run", "size", "offset")})

    return add

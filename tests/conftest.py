import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from riskweave.session import local_session, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = prepare(local_session("tests", "8", 4))
    yield s


@pytest.fixture
def make_tx(spark):
    """Transfers from (sender, receiver, amount) triples, one minute apart."""
    from pyspark.sql import functions as F

    def build(rows):
        data = [(f"tx_{i:03d}", s, r, float(a), i) for i, (s, r, a) in enumerate(rows)]
        df = spark.createDataFrame(data, "transaction_id string, sender_wallet string, receiver_wallet string, amount double, ord bigint")
        stamp = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("ord") * 60)
        return df.withColumns(
            {"timestamp": stamp, "fee": F.lit(0.5), "asset_type": F.lit("ETH"), "chain_id": F.lit("ethereum"), "label": F.lit(None).cast("string")}
        )

    return build

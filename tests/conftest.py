import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from strata.session import build_session
    s = build_session("local[*]", "strata-tests", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sample_sales(spark):
    return spark.createDataFrame(
        [("REGION_A", "GROCERY", "BRAND_X", "202401", 100.0, 10),
         ("REGION_A", "GROCERY", "BRAND_Y", "202401", 200.0, 20),
         ("REGION_B", "SERVICES", "BRAND_X", "202402", 150.0, 15),
         ("REGION_B", "ENTERTAINMENT", "BRAND_Z", "202402", 300.0, 30)],
        "btlr_org_lvl_c string, trade_group string, brand_nm string, month_id string, "
        "hl_qty double, transaction_count long")

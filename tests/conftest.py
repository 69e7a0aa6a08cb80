import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from riskstream.session import build_session, checkpoint_dir

    s = build_session("local[*]", app="riskstream-tests", **{"spark.sql.shuffle.partitions": "8"})
    checkpoint_dir(s)  # tests: the session names no shared folder, so a private one is created
    yield s
    s.stop()


@pytest.fixture()
def workdir():
    return tempfile.mkdtemp(prefix="rs-test-")


ALERT_SCHEMA = ("dimension string, window_size string, dimension_key string, txn_count bigint, "
                "total_amount double, window_start bigint, window_end bigint")


@pytest.fixture()
def alerts(spark):
    def make(rows):
        return spark.createDataFrame(rows, ALERT_SCHEMA)

    return make


TX_SCHEMA = ("transaction_id string, user_id string, amount double, currency string, event_time timestamp_ntz, "
             "merchant_id string, location string, device_id string, ip_address string")


@pytest.fixture()
def transactions(spark):
    import datetime as dt

    def make(rows):
        t0 = dt.datetime(2026, 1, 15, 10, 30)
        full = []
        for i, r in enumerate(rows):
            d = {"transaction_id": f"t{i}", "user_id": "User_1", "amount": 100.0, "currency": "USD",
                 "event_time": t0 + dt.timedelta(seconds=i), "merchant_id": "Merch_1", "location": "US",
                 "device_id": "Dev_1", "ip_address": "192.168.1.10"}
            d.update(r)
            full.append(tuple(d[k] for k in ["transaction_id", "user_id", "amount", "currency", "event_time",
                                             "merchant_id", "location", "device_id", "ip_address"]))
        return spark.createDataFrame(full, TX_SCHEMA)

    return make

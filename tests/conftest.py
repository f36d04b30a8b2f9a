import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from temblor.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(4, "tests", partitions=4, memory="4g")
    yield session
    session.stop()


@pytest.fixture
def sf():
    return SF


@pytest.fixture(scope="session")
def events(spark):
    """Random events with ties in time and magnitude; one zone holds a third."""
    import random

    random.seed(7)
    rows = []
    for seq in range(400):
        zone = 0 if random.random() < 0.34 else random.randint(1, 5)
        second = random.randint(0, 40) * 3600 if zone else random.randint(0, 12) * 3600
        rows.append((f"ev{seq:03d}", seq, 1_000_000_000_000_000 + second * 1_000_000, 10.0 * zone + random.random(),
                     20.0 * zone + random.random(), float(random.randint(0, 700)), random.randint(0, 70) / 10.0,
                     f"z{zone}" if zone != 4 else None))
    schema = ("id string, seq bigint, us bigint, latitude double, longitude double, depth double, mag double, "
              "region_code string")
    frame = spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_micros(us) as time").drop("us")
    return frame.persist()

"""First hellos of flows with many packets."""

import random

from sessionlens.operators import packets
from sessionlens.plans import catalog

from .helpers import spark_rows


def hello(kind, n):
    return bytearray(b"\x16\x03\x01\x00\x10" + bytes([kind]) + bytes([n % 256]) * (n % 40))


def test_long_flows_have_the_same_first_hellos(spark):
    """Equal times, missing times and keys, other payloads: as without the first times."""
    rnd = random.Random(4)
    rows = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2]), rnd.choice([None, *range(3, 9)] if k % 9 == 0 else [3, 4, 5, 9]), k, rnd.choice([hello(1, k), hello(2, k), hello(3, k), bytearray(b"GET /"), None])) for k in range(400)]
    rows += [("c", 1, 5, 500, hello(2, 500)), ("c", 1, 6, 501, hello(1, 501)), ("c", 1, 4, 502, hello(3, 502)), ("d", 1, 1, 503, bytearray(b"x")), ("c", 2, 7, 504, hello(1, 39)), ("c", 2, 7, 505, hello(1, 38))]
    df = spark.createDataFrame(rows, "ip string, port int, ts_ns long, seq int, payload binary")
    plain = packets.first_hellos(df, ["ip", "port"], most=20)
    assert spark_rows(packets.first_hellos(df, ["ip", "port"], most=20, long_flows=True)) == spark_rows(plain) and plain.count() == 15


def test_captured_packets_are_made_once_a_pass_and_few_are_sorted(spark, small):
    plan = catalog.captured_hellos(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(x") == 2 and plan.count("LeftSemi") == 1

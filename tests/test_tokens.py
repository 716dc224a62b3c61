import base64
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import names, times, tokens
from tidemark.operators import watermarks


def crc(data: bytes) -> int:
    c = 0xFFFFFFFF
    for byte in data:
        c ^= byte
        for _ in range(8):
            c = c >> 1 ^ (0x82F63B78 if c & 1 else 0)
    return c ^ 0xFFFFFFFF


def digits(data: bytes) -> str:
    """Least significant byte first."""
    return crc(data).to_bytes(4, "little").hex()


def made(server, ms, check=None):
    body = json.dumps({"server_type": server, "started_at_ms": ms, "crc32c": check or digits(f"{server}{ms}".encode())}, separators=(",", ":"))
    return base64.urlsafe_b64encode(body.encode()).decode().rstrip("=")


def test_checksum(spark):
    rows = spark.createDataFrame([("123456789",), ("",), ("é",), ("ledger1745000000000",)], "t string")
    got = [r[0] for r in rows.select(tokens.crc32c(F.col("t"))).collect()]
    assert got[0] == "839206e3" and got == [digits(t.encode()) for (t,) in rows.collect()]
    assert rows.select(tokens.crc32c(F.col("t"), reverse_bytes=False)).first()[0] == "e3069283"


def test_tokens_are_those_of_a_plain_encoder(spark):
    for server, ms in (("ledger", 1745000000000), ("auditor", 0), ("auditor", 9007199254740992)):
        assert watermarks.token(spark, server, ms) == made(server, ms)
        assert watermarks.read_token(spark, made(server, ms) + "==", server) == ms


def test_verdicts_in_order(spark):
    rows = [
        (made("ledger", 5), "ledger", "OK"), (made("ledger", 5, "deadbeef"), "ledger", "001"), ("!!!not-base64!!!", "ledger", "002"), (None, "ledger", "002"), ("", "ledger", "002"),
        (base64.urlsafe_b64encode(b"{not valid json}").decode(), "ledger", "002"), (base64.urlsafe_b64encode(b'{"server_type":"ledger"}').decode(), "ledger", "002"),
        (made("ghost", 5, "deadbeef"), "ledger", "003"), (made("auditor", 5), "ledger", "005"), (made("ledger", 5), "auditor", "006"), ("_w", "ledger", "002"),
    ]
    frame = spark.createDataFrame(rows, "token string, expected string, want string")
    assert all(r.verdict == r.want for r in watermarks.judged(frame, "expected").collect())


def test_refused_tokens_raise(spark):
    with pytest.raises(watermarks.BadToken, match="005"):
        watermarks.read_token(spark, made("auditor", 5), "ledger")
    with pytest.raises(watermarks.BadToken, match="002"):
        watermarks.read_token(spark, None, "ledger")


@pytest.mark.parametrize("ledger,auditor", [(20, 10), (10, 20), (10, 10)])
def test_boundary_is_the_earlier_one(spark, ledger, auditor):
    rows = [("d", "ledger", ledger), ("d", "auditor", auditor), ("d", "ledger", 1), ("half", "ledger", 5)]
    assert [tuple(r) for r in watermarks.boundaries(spark.createDataFrame(rows, "domain string, server_type string, started_at_ms long")).collect()] == [("d", 10)]


def test_names_and_times(spark):
    row = spark.range(1).select(
        names.physical_namespace("base", F.lit("default")), names.physical_namespace("base", F.lit("ns1")), *names.split_qualified(F.lit("a.b.c")),
        F.expr("timestamp_ntz'1999-01-01 00:00:10.0015'").alias("t"),
    ).withColumn("ms", times.epoch_ms("t")).first()
    assert tuple(row)[:4] == ("base", "base_ns1", "a", "b.c") and row.ms == 915148810001
    assert times.lock_boundary(20_000) == 5_000

"""Scalar expressions on the sample texts of FIXTURES.md section 1."""

import random
import time

import pytest
from pyspark.sql import functions as F

from rollcall.functions import expressions as X

PINGS = [
    ("Reply from 10.0.0.1: bytes=32 time<1ms TTL=64", True),
    ("来自 10.0.0.1 的回复: 字节=32 时间=1ms TTL=64", True),
    ("Pinging x\r\nReply from 10.0.0.1: bytes=32 time=3ms TTL=64\r\n", True),
    ("Request timed out.", False),
    ("Reply from 10.0.0.9: Destination host unreachable.", False),
    ("64 bytes from 10.0.0.1: icmp_seq=1 ttl=64 time=0.1 ms", False),
    ("reply from 10.0.0.1: BYTES=32 TIME=2MS ttl=64", True),  # case-insensitive
    (None, False),
]


def test_probe_up(spark):
    df = spark.createDataFrame([(t,) for t, _ in PINGS], "output string")
    got = [r.up for r in df.select(X.probe_up("output").alias("up")).collect()]
    assert got == [u for _, u in PINGS]


CHECKINS = [
    ("connect to [10.0.0.1] from (UNKNOWN) [10.0.0.2] 49152", "GET /?MAC=ab12cd HTTP/1.1",
     "10.0.0.2", "ab12cd"),
    ("CONNECT TO [10.0.0.1] FROM (UNKNOWN) [10.0.0.3] 5", "GET /?MAC=ABC HTTP/1.1",
     "10.0.0.3", "ABC"),
    ("connect to [10.0.0.1] from (host.lan) [10.0.0.2] 49152", "POST / HTTP/1.1", None, None),
    ("connect to [10.0.0.1] from (UNKNOWN) [10.0.0.2] port", "get /?MAC=abc HTTP/1.1",
     None, None),
    (None, None, None, None),
]


def test_checkin_fields(spark):
    df = spark.createDataFrame([c[:2] for c in CHECKINS], "connect_line string, request_line string")
    got = [(r.ip, r.mac) for r in df.select(X.checkin_ip("connect_line").alias("ip"),
                                            X.checkin_mac("request_line").alias("mac")).collect()]
    assert got == [(c[2], c[3]) for c in CHECKINS]


@pytest.mark.parametrize("phys,nc,path,expected", [
    (True, "10.1.1.1", "/a.vmx", "wol"),
    (None, "10.1.1.1", "/a.vmx", "remote"),
    (False, "", "/a.vmx", "local"),
    (False, None, "", None),
    (None, None, None, None),
])
def test_power_source_truthiness(spark, phys, nc, path, expected):
    df = spark.createDataFrame([(phys, nc, path)], "p boolean, nc string, path string")
    assert df.select(X.power_source("p", "nc", "path").alias("s")).first().s == expected


def test_state_line_spacing(spark):
    df = spark.createDataFrame([(True, True, 0, 3, "M1", "1.2.3.4"),
                                (False, None, 2, 3, "M2", None)],
                               "up boolean, m boolean, i long, n long, mac string, ip string")
    got = [r.l for r in df.select(X.state_line("up", "m", "i", "n", "mac", "ip").alias("l")).collect()]
    assert got == ["on  master 0 3 M1 1.2.3.4", "off slave  2 3 M2 "]


def test_listing_entries(spark):
    df = spark.createDataFrame([("10.0.0.5", 3)], "ip string, idx long")
    r = df.select(X.dns_entry("ip", "idx").alias("d"), X.hosts_entry("ip", "idx").alias("h")).first()
    assert (r.d, r.h) == ("10.0.0.5-node3", "10.0.0.5 node3")


def test_mac_key_case_fold(spark):
    df = spark.createDataFrame([("e0cb4e",), (None,)], "m string")
    assert [r.k for r in df.select(X.mac_key("m").alias("k")).collect()] == ["E0CB4E", None]
    assert df.where(F.col("m").isNull()).count() == 1


def _random_texts(pieces, count, longest, seed):
    rng = random.Random(seed)
    return [("".join(rng.choice(pieces) for _ in range(rng.randrange(longest))),) for _ in range(count)]


def test_one_pass_chains_equal_the_fixed_patterns(spark):
    probe = [" ", "1", "12.3.4.5", " 1.2.3.4", ".", "=", "=32", "3ms TTL=6", "ms ttl=1", "\n", "\r\n", " ", "x", "大"]
    line = ["connect to [", "CONNECT TO [", "10.0.0.1", "] from (", "ab_1", ") [", "] 12", "]", " ", "7", "\n", "\r", "\r\n",
            "] from (A) [", "GET /?MAC=", "aB", " HTTP/1.1", "\u0085", "x"]
    df = spark.createDataFrame(_random_texts(probe, 6000, 14, 1), "t string")
    old = F.col("t").rlike("(?i)" + X.PROBE_UP_PATTERN)
    both = df.select("t", old.alias("old"), X.probe_up("t").alias("new"))
    assert both.where("old <> new").collect() == []
    assert both.where("old").count() > 100
    df = spark.createDataFrame(_random_texts(line, 20000, 12, 2), "t string")

    def part(pattern):
        return F.nullif(F.regexp_extract("t", pattern, 1), F.lit(""))

    both = df.select("t", part("(?i)" + X.CONNECT_LINE_PATTERN).alias("ip"), X.checkin_ip("t").alias("ip2"),
                     part(X.REQUEST_LINE_PATTERN).alias("mac"), X.checkin_mac("t").alias("mac2"))
    assert both.where("NOT (ip <=> ip2) OR NOT (mac <=> mac2)").collect() == []
    assert both.where("ip IS NOT NULL").count() > 20 and both.where("mac IS NOT NULL").count() > 20


@pytest.mark.parametrize("text", [
    " 1.1.1.1=1", "1", " ", "=1", " 1.1.1.1", "1ms TTL=", "connect to [", "] from (a) [", "] 1", "(" + "a" * 50,
    "GET /?MAC=", "connect to [] from (a) [] 1x", "\n", " 1.1.1.1=1\n", "=11ms TTL=\r"])
def test_a_hostile_megabyte_is_read_once(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(
        F.repeat("t", (1 << 20) // len(text)).alias("t"))
    start = time.monotonic()
    df.select(X.probe_up("t"), X.checkin_ip("t"), X.checkin_mac("t")).collect()
    assert time.monotonic() - start < 3

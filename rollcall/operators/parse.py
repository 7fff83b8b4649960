"""Q2 and Q3: turning landed text into typed rows (narrow, no shuffle)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollcall.functions.expressions import checkin_ip, checkin_mac, probe_up


def parse_probes(probes: DataFrame, output: str = "output") -> DataFrame:
    """probes(seq, ts, node, output) -> (seq, ts, node, up)."""
    return probes.select("seq", "ts", "node", probe_up(output).alias("up"))


def parse_checkins(checkins: DataFrame, connect_line: str = "connect_line",
                   request_line: str = "request_line") -> DataFrame:
    """checkins(seq, ts, connect_line, request_line)
    -> (seq, ts, ip, mac, malformed).

    A line that does not match gives a null field (the address or the MAC),
    never the line itself; ``malformed`` marks rows with either missing.
    """
    parsed = checkins.select("seq", "ts", checkin_ip(connect_line).alias("ip"),
                             checkin_mac(request_line).alias("mac"))
    return parsed.withColumn("malformed", F.col("ip").isNull() | F.col("mac").isNull())

"""Fleet tables derived from the driver's tables (the stand-in inputs).

These only shape rows into the schemas the jobs read; they do none of the
jobs' work. The same views are written in DuckDB SQL in
``rollcall.plans.oracle`` for the independent check.

* ``fleet``      inventory from ``supplier``: cluster = nation, node = supplier
                 (a row without a nation belongs to no cluster and is left out)
* ``fleet_wide`` the same from ``customer`` (clusters never fully covered)
* ``probes``     one ping output per event
* ``checkins``   the two listener lines of each ``signup`` event
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.operators.scan import row_index
from rollcall.sources.tables import read_table

FLEET_COLUMNS = ["cluster", "node", "idx", "mac", "ip", "is_master",
                 "is_physical", "nc", "vmware", "path"]


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def mac_of(node: str | F.Column) -> F.Column:
    """Stand-in MAC of a node id: 'MAC' and the id padded to 9 digits."""
    return F.concat(F.lit("MAC"), F.lpad(_s(node), 9, "0"))


def fleet_from(df: DataFrame, cluster: str, node: str, acctbal: str) -> DataFrame:
    base = df.select(
        F.col(cluster).alias("cluster"),
        F.col(node).alias("node"),
        (F.col(acctbal) >= 5000).alias("is_master"),
    ).where(F.col("cluster").isNotNull())
    kind = F.col("node") % 4
    shaped = base.select(
        "cluster", "node",
        mac_of("node").alias("mac"),
        F.concat(F.lit("10.0."), _s("cluster"), F.lit("."), _s("node")).alias("ip"),
        "is_master",
        F.when(kind == 0, F.lit(True)).when(kind == 3, F.lit(None)).otherwise(F.lit(False))
         .alias("is_physical"),
        F.when(kind == 1, F.concat(F.lit("10.250."), _s("cluster"), F.lit(".1")))
         .otherwise(F.lit("")).alias("nc"),
        F.when(kind == 1, F.lit("/opt/vmware/bin/vmrun")).alias("vmware"),
        F.when(kind.isin(1, 2), F.concat(F.lit("/vm/node"), _s("node"), F.lit(".vmx")))
         .otherwise(F.lit("")).alias("path"),
    )
    return row_index(shaped, ["cluster"], ["node"], "idx").select(*FLEET_COLUMNS)


def fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = read_table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey", "s_acctbal"])
    return fleet_from(sup, "s_nationkey", "s_suppkey", "s_acctbal")


def fleet_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    cus = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    return fleet_from(cus, "c_nationkey", "c_custkey", "c_acctbal")


def shared_macs(fleet: DataFrame) -> DataFrame:
    """The inventory with one MAC for every two nodes (of node div 2)."""
    return fleet.withColumn("mac", mac_of(F.expr("node div 2")))


def shared_nodes(fleet: DataFrame) -> DataFrame:
    """The inventory with one node id for every three rows (of node div 3), in
    one cluster or in several."""
    return fleet.withColumn("node", F.expr("node div 3"))


def write_inventory_json(fleet: DataFrame, path: str) -> None:
    """The inventory as files in the form ``read_inventory`` takes: one
    commented JSON array per cluster. A cluster's file is one document, so one
    row; this only makes an input file for the reader."""
    fields = F.struct(F.col("ip").alias("IP"), F.col("mac").alias("MAC"),
                      F.col("is_master").alias("isMaster"), F.col("is_physical").alias("isPhysical"),
                      F.col("nc").alias("NC"), "vmware", "path")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("idx", F.to_json(fields).alias("j")))),
                       lambda r: r["j"])
    text = F.concat(F.lit("/* inventory */ [\n"), F.array_join(rows, " /* next */ ,\n"), F.lit("\n]"))
    (fleet.groupBy("cluster").agg(text.alias("value"))
     .repartition("cluster")
     .write.partitionBy("cluster").option("lineSep", "\n").text(path))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts of waits: every 250th event starts a run, of the clusters (25
    nations) in turn."""
    eid = F.col("event_id")
    return (read_table(spark, sf_dir, "events", ["event_id"]).where(eid % 250 == 0)
            .select(eid.alias("run_id"), F.expr("cast((event_id div 250) % 25 as int)").alias("cluster"),
                    eid.alias("start_seq")))


def coarse_seq(probes: DataFrame) -> DataFrame:
    """Probes in a coarse order: seven events share a seq (and the least ts of
    their seven is no longer told apart)."""
    return probes.withColumn("seq", F.expr("seq div 7"))


def probes_from(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    reply_ip = F.concat(F.lit("10.0.0."), _s(uid))
    ms = _s(eid % 9 + 1)
    output = (
        F.when((F.col("event_type") == "error") & (eid % 2 == 0), F.lit("Request timed out."))
        .when(F.col("event_type") == "error",
              F.concat(F.lit("Reply from "), reply_ip, F.lit(": Destination host unreachable.")))
        .when(eid % 3 == 0,
              F.concat(F.lit("Reply from "), reply_ip, F.lit(": bytes=32 time="), ms, F.lit("ms TTL=64")))
        .when(eid % 3 == 1,
              F.concat(F.lit("Reply from "), reply_ip, F.lit(": bytes=32 time<1ms TTL=128")))
        .otherwise(F.concat(F.lit("来自 "), reply_ip, F.lit(" 的回复: 字节=32 时间="), ms, F.lit("ms TTL=64")))
    )
    return events.select(eid.alias("seq"), "ts", uid.alias("node"), output.alias("output"))


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return probes_from(ev)


def checkins_from(events: DataFrame) -> DataFrame:
    eid, uid = F.col("event_id"), F.col("user_id")
    host = F.when(eid % 50 == 0, F.lit("(host.lan)")).otherwise(F.lit("(UNKNOWN)"))
    addr = F.concat(F.lit("172.16."), _s(uid % 250), F.lit("."), _s(eid % 250))
    connect = F.concat(F.lit("connect to [10.0.0.1] from "), host, F.lit(" ["), addr,
                       F.lit("] "), _s(eid % 1000 + 49152))
    mac = F.when(eid % 2 == 1, F.lower(mac_of(uid))).otherwise(mac_of(uid))
    request = (F.when(eid % 53 == 0, F.lit("POST / HTTP/1.1"))
               .otherwise(F.concat(F.lit("GET /?MAC="), mac, F.lit(" HTTP/1.1"))))
    return (events.where(F.col("event_type") == "signup")
            .select(eid.alias("seq"), "ts", connect.alias("connect_line"),
                    request.alias("request_line")))


def checkins(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    return checkins_from(ev)

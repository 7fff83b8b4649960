"""Q1 source: machine inventories written as JSON arrays with /* */
comments, one file per cluster.

Each file is one JSON document. Small files are read whole (``wholetext``), many
in parallel, one task per file; with a file beyond ``rollcall.inventory.wholeFileBytes``
(32 MB) files are split and read by many tasks (``json_split``). Rows are the same
both ways. The array is parsed with Spark's JSON parser with comments allowed and
FAILFAST (a malformed file raises; it is never evaluated as code), and its
elements get their position ``idx``.

The cluster of a file is its ``cluster=<name>`` folder when the files are laid
out that way, else the file name without extension. It is taken from the path
as text, so ``007`` and ``7`` are two clusters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollcall.sources.json_split import read_split_arrays

# The inventory's field names as written in the files.
INVENTORY_SCHEMA = ("array<struct<IP: STRING, MAC: STRING, isMaster: BOOLEAN, "
                    "isPhysical: BOOLEAN, NC: STRING, vmware: STRING, path: STRING>>")

JSON_OPTIONS = {"allowComments": "true", "mode": "FAILFAST"}


#: size from which a file is split
WHOLE_FILE_BYTES = 32 << 20


def read_inventory(spark: SparkSession, path: str | list[str], split: bool | None = None) -> DataFrame:
    """Inventory files -> (cluster, node, idx, mac, ip, is_master,
    is_physical, nc, vmware, path), one row per array element in file order.

    split: True splits files, False reads each whole, None decides by the
    largest file. Content behind the end of an array is passed over, or, where the
    split reader meets a whole object there that it would count, an error.

    The files carry no machine id, so ``node`` (the id probes are keyed by)
    is null until the caller assigns one, e.g. ``withColumn("node", ...)``."""
    paths = [path] if isinstance(path, str) else list(path)
    if split is None:
        limit = int(spark.conf.get("rollcall.inventory.wholeFileBytes", str(WHOLE_FILE_BYTES)))
        largest = spark.read.format("binaryFile").load(paths).agg(F.max("length")).first()[0]
        split = (largest or 0) > limit
    if split:
        rows = read_split_arrays(spark, paths, INVENTORY_SCHEMA, JSON_OPTIONS, "IP")
    else:
        docs = spark.read.text(paths, wholetext=True).select(
            F.col("_metadata.file_path").alias("path"),
            F.from_json("value", INVENTORY_SCHEMA, JSON_OPTIONS).alias("rows"))
        rows = docs.select("path", F.posexplode("rows").alias("idx", "r"))
    folder = F.regexp_extract("path", r"/cluster=([^/]+)/[^/]*$", 1)
    name = F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1)
    cluster = F.url_decode(F.replace(F.when(folder != "", folder).otherwise(name),
                                     F.lit("+"), F.lit("%2B")))
    return rows.select(
        cluster.alias("cluster"), F.lit(None).cast("long").alias("node"), F.col("idx").cast("long").alias("idx"),
        F.col("r.MAC").alias("mac"), F.col("r.IP").alias("ip"),
        F.col("r.isMaster").alias("is_master"), F.col("r.isPhysical").alias("is_physical"),
        F.col("r.NC").alias("nc"), F.col("r.vmware").alias("vmware"), F.col("r.path").alias("path"))

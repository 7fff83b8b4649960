"""Q9 sinks: the state report and the peer listings, written per cluster.

Nothing is gathered into one string or one task: rows are range-partitioned on
(cluster, idx), so the part files of a cluster's folder, read in name order,
are its rows in order, however large the cluster. The number of ranges is the
measured size over ``FILE_BYTES``: a hot cluster gets several files, a small one
one (or two, where a range ends in it), together at most bytes / FILE_BYTES plus
the number of clusters.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rollcall.functions.expressions import DNS_SEPARATOR, HOSTS_SEPARATOR
from rollcall.operators.scan import row_index
from rollcall.session import cut_lineage

__all__ = ["DNS_SEPARATOR", "HOSTS_SEPARATOR", "export_table", "read_export",
           "write_listing", "write_listings", "read_listing"]


#: bytes of text a file is to have
FILE_BYTES = 128 << 20


def _in_ranges(df: DataFrame, keys: list[str], file_bytes: int, num_partitions: int | None = None) -> DataFrame:
    """``df`` sorted by ``keys`` in ranges of about ``file_bytes``, by the length of
    its rows as text. It is written once, as it is measured, sampled and dealt."""
    df = cut_lineage(df)
    if num_partitions is None:
        size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
        num_partitions = max(1, math.ceil(size / file_bytes))
    return df.repartitionByRange(num_partitions, *keys).sortWithinPartitions(*keys)


def export_table(df: DataFrame, path: str, fmt: str = "json", partition_by: str = "cluster",
                 mode: str = "overwrite", order: str = "idx", file_bytes: int = FILE_BYTES) -> None:
    """Write a report per cluster (JSON lines, Parquet, ...), in ``order`` across
    the files of a cluster."""
    (_in_ranges(df, [partition_by, order], file_bytes)
     .write.mode(mode).partitionBy(partition_by).format(fmt).save(path))


def _placed(lines: DataFrame) -> DataFrame:
    """Rows of files with ``position``, their place in their cluster's files."""
    placed = lines.select("*", F.col("_metadata.file_path").alias("_f"),
                          F.col("_metadata.file_block_start").alias("_b"),
                          F.monotonically_increasing_id().alias("_m"))
    return row_index(placed, ["cluster"], ["_f", "_b", "_m"], "position").drop("_f", "_b", "_m")


def read_export(spark: SparkSession, path: str, schema: StructType, fmt: str = "json",
                partition_by: str = "cluster", position: bool = False) -> DataFrame:
    """Read back an export with the given schema (the partition column comes
    from the folder names); with ``position`` also each row's place in its
    cluster's files, from 0 (for exports by cluster)."""
    body = StructType([f for f in schema.fields if f.name != partition_by]
                      + [schema[partition_by]])
    df = spark.read.schema(body).format(fmt).load(path)
    extra = []
    if position:
        df, extra = _placed(df), ["position"]
    return df.select(*[F.col(c) for c in [*schema.fieldNames(), *extra]])


def write_listing(context: DataFrame, path: str, entry: str = "hosts_entry",
                  separator: str = HOSTS_SEPARATOR, num_partitions: int | None = None,
                  header: list[str] | None = None) -> None:
    """One text listing per cluster from node rows (cluster, idx, entry):
    the ``header`` entries, then each entry followed by ``separator``, in idx
    order across part files.

    ``hosts_entry`` with a newline is the hosts-file form; ``dns_entry`` with
    ``DNS_SEPARATOR`` is the comma-separated form (with a trailing comma).
    """
    rows = context.select("cluster", F.col("idx").cast("long").alias("idx"),
                          F.col(entry).alias("value"))
    if header:
        lines = F.posexplode(F.array(*[F.lit(h) for h in header])).alias("_at", "value")
        rows = rows.unionByName(
            context.select("cluster").distinct().select("cluster", lines)
            .select("cluster", (F.col("_at") - len(header)).cast("long").alias("idx"), "value"))
    (_in_ranges(rows, ["cluster", "idx"], FILE_BYTES, num_partitions)
     .drop("idx")
     .write.mode("overwrite").option("lineSep", separator)
     .partitionBy("cluster").text(path))


def write_listings(context: DataFrame, path: str) -> None:
    """Both listings under ``path``/hosts and ``path``/dns."""
    write_listing(context, f"{path}/hosts", "hosts_entry", HOSTS_SEPARATOR)
    write_listing(context, f"{path}/dns", "dns_entry", DNS_SEPARATOR)


def read_listing(spark: SparkSession, path: str, separator: str = HOSTS_SEPARATOR,
                 cluster_type: str = "string", position: bool = False) -> DataFrame:
    """(cluster, value) lines of a listing written by ``write_listing``; with
    ``position`` also each line's place in its cluster's listing, from 0."""
    lines = (spark.read.schema(f"value string, cluster {cluster_type}")
             .option("lineSep", separator).text(path))
    if not position:
        return lines.select("cluster", "value")
    return _placed(lines).select("cluster", "value", "position")

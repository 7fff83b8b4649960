"""rollcall: fleet roll-call analytics on Spark.

Batch and streaming jobs over machine inventories, liveness probes and
check-in reports, keyed by cluster: which nodes are up, which have reported,
when a cluster was first all up, and when each node was reached in an ordered
bring-up or shutdown.
"""

__version__ = "0.1.0"

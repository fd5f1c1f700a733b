"""mobilis: transit-feed and ride-hailing analytics on Spark DataFrames.

Every operator is ``DataFrame -> DataFrame`` built from Spark's own
expressions, so Catalyst plans the work and it scales with the cluster.
Grouping by ``city`` happens whenever the input carries a ``city`` column.
"""

__version__ = "0.1.0"

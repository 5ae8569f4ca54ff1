"""Change-data-capture analytics on Spark DataFrames.

Frames of a logical-replication log are decoded, assembled into committed
transactions, cast to types and replayed into queryable state.
"""

__version__ = "0.1.0"

"""rtq — round-trip translation quality on Spark.

Every public function maps DataFrames to DataFrames; nothing collects data
to the driver except scalar results (counts, loop convergence checks).
"""

__all__ = ["session"]

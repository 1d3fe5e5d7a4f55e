"""tabsleuth: Spark-native table profiling, association and baseline-model evaluation.

Every operator takes DataFrames and returns DataFrames. The heavy lifting is
Spark aggregation, joins and windows; only per-column / per-pair / per-model
summary rows ever reach the driver.
"""

__version__ = "0.1.0"

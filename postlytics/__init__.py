"""postlytics: feature, exploration, statistics and model operators for tables of
timestamped, scored, text-bearing records, written as Spark DataFrame plans.

Every operator is a function ``DataFrame -> DataFrame`` (or a small, bounded
result table).  Nothing row-sized is collected to the driver.
"""

__version__ = "0.1.0"

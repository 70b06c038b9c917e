"""bazaar — Spark-native analytics over a flat table of sales orders.

Every operator is a lazy ``DataFrame -> DataFrame`` function built from
``pyspark.sql.functions``; nothing is collected to the driver.
"""

__version__ = "0.1.0"

"""gnomon: a Spark-first analytics engine for quantitative market data.

Every operator is a lazy ``DataFrame -> DataFrame`` function.
"""

__version__ = "0.1.0"

"""permea: a Spark-native engine for membrane-recipe analytics.

Every operator is a ``DataFrame -> DataFrame`` function built from Spark SQL
expressions, joins, aggregates and Spark ML estimators, so each one runs
unchanged on a laptop (``local[8]``) or a large cluster.
"""

__version__ = "0.1.0"

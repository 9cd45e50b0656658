"""riskpanel: Spark-native operators for temporal risk panels.

Every public operator takes and returns a ``pyspark.sql.DataFrame``; the
work runs as Spark SQL / Spark ML plans. Subpackages:

* ``sources``   readers, lookups and sinks
* ``functions`` column expressions (bands, flags, text, row-wise helpers)
* ``operators`` DataFrame -> DataFrame operators (panel, profile, quality,
  selection, evaluation, fairness, reshape)
* ``ml``        preprocessing, models, temporal tuning, scoring
* ``plans``     composed plans over the test tables and the query registry
* ``streaming`` stateless batch scoring under Structured Streaming
"""

__version__ = "0.1.0"

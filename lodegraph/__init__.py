"""lodegraph: a Spark-native analytics engine for knowledge corpora."""

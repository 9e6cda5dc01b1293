"""sparrowmill: a Spark-native engine for building, auditing and evaluating large corpora."""

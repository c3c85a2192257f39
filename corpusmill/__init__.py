"""corpusmill: a Spark-native engine for curating and judging text training corpora."""

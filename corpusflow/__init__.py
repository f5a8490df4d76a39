"""corpusflow: Spark DataFrame operators that build, search and evaluate document corpora."""

"""corpusmill: a PySpark-native engine for preparing, retrieving, gating and grading text corpora."""

"""foliant: a PySpark-native engine for branching documents and text corpora."""

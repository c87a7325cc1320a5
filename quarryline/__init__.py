"""quarryline: a PySpark-native engine for document retrieval and dataset pipelines."""

"""A Spark-native engine from documents to a knowledge graph."""

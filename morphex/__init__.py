"""Spark-native analytics over specimen embeddings, label sheets and cluster assignments."""

"""Text-corpus retrieval, verification and training-data preparation on Spark."""

"""PySpark-native analytics for repairing, structuring and aligning multilingual document text."""

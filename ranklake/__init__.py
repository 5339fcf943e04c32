"""PySpark-native analytics for ranked results and text corpora."""

"""loomtext: a Spark-native engine for multi-label text-corpus analytics."""

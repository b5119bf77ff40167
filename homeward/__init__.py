"""homeward: a Spark-native engine for lost-pet matching and search-area ranking."""

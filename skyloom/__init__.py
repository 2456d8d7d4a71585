"""skyloom: Spark-native air-quality analytics (plus the optional ``skyloom.llm`` corpus operators)."""

"""engrava: Spark-native vector memory, journal state and access analytics."""

"""plazaflow: a Spark-native engine for discussion records and survey tables."""

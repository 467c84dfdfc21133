"""sijill: a PySpark-native engine that turns documents into grounded, fixed-schema records."""

"""A Spark-native engine for electrochemical sensor data."""

"""PySpark-native household-finance and receipt analytics."""

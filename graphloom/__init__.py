"""graphloom: a PySpark-native analytics engine for software graphs."""

"""A PySpark-native analytics engine: operators from DataFrame to DataFrame and the queries made of them."""

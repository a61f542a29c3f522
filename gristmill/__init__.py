"""A PySpark-native analytics engine for profiling databases and judging the SQL written against them."""

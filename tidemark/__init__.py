"""A PySpark-native analytics engine: metrics, records, search, SQL, calculations and schema profiling."""

"""A PySpark-native analytics engine for retrieval, telemetry and serving workloads."""

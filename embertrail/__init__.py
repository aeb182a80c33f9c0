"""embertrail: a Spark-native analytics engine for thermal imagery and flight telemetry."""

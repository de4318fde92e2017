"""tidemill: a Spark-native engine for raw, defect-laden operational data."""

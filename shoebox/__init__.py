"""Media catalog analytics as Spark DataFrame plans over Parquet snapshots."""

"""lumenlog: Spark-native analytics over machine logs and operators' texts."""

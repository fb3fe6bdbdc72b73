"""tidewheel: a Spark-native engine for robot-episode data and corpus preparation."""

"""Spark-native analytics over private text: detection, typed placeholders, restore, reports and streams."""

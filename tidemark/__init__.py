"""tidemark: point-in-time cross-sectional analytics as composable Spark DataFrame operators."""

"""Labour-market batch and streaming jobs as composable PySpark functions."""

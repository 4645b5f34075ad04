"""Labour-market analytics as lazy, composable PySpark operators."""

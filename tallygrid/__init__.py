"""Sales analytics and bulk order processing as Spark DataFrame operators."""

"""Asset analytics and recommendation evaluation as lazy Spark DataFrame operators."""

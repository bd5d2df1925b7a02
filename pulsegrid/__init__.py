"""Product, trading and operations analytics as lazy Spark DataFrame functions."""

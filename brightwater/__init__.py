"""Analytics queries written with the public PySpark DataFrame API."""

"""Analytics of free-text appointment requests as Spark DataFrame operators."""

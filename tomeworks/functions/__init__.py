"""Column functions: native Spark expressions where they can say it, Arrow UDFs where they can't."""

"""Analytics over collections of short texts, and corpus preparation, on PySpark."""

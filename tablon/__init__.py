"""Analytics over classified listings that are collected in repeated runs, on PySpark."""

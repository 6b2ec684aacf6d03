"""Operators for preparing language-model training data, each a Spark job over
``documents``-like tables. Nothing outside this package imports it."""

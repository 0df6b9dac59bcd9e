"""Tessera: sequence comparison, unsupervised learning and corpus preparation on PySpark."""

"""Weftline: item-catalogue harmonisation and training-data preparation on PySpark."""

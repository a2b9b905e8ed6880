"""Operators for preparing training data; nothing else in weftline imports this package."""

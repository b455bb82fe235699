"""Retail demand and inventory analytics as PySpark DataFrame functions."""

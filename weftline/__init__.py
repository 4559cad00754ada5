"""Weftline: weight, vector and corpus analytics as Spark DataFrame plans."""

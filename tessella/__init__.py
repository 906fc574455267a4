"""Tessella: catalogue-to-quote analytics as Spark DataFrame jobs."""

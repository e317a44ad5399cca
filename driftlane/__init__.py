"""Exposure-profile analytics as Spark DataFrame jobs."""

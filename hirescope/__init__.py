"""Hiring-market analytics as Spark DataFrame jobs."""

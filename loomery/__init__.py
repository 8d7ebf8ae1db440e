"""Loomery: text, knowledge and state analytics as Spark DataFrame and SQL queries."""

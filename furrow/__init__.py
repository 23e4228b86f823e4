"""Furrow: agricultural price, news and crop analytics as Spark DataFrame jobs."""

"""Retail sales analytics as Spark jobs: customer value, product offers, demand forecasts."""

"""Table quality, cleaning and KPI analytics as PySpark DataFrame operators."""

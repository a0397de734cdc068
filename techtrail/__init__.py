"""PySpark library about technologies in projects over time, and corpus preparation."""

"""kinetable: trajectory, event and training-text analytics on PySpark."""

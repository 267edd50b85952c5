"""Training, ranking, explaining and applying models with Spark ML."""

"""Table analytics and training-data jobs expressed as Spark DataFrame plans."""

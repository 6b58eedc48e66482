"""Classical machine learning and data mining as Spark DataFrame plans."""

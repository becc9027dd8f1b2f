"""corpusloom: corpus preparation, retrieval and evaluation as Spark DataFrame plans."""

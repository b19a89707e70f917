"""tessera: grounded retrieval and its evaluation as Spark DataFrame jobs."""

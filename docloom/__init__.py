"""Document intelligence and hybrid retrieval as Spark DataFrame plans."""

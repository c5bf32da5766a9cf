"""velora: corpus, vector and sequence operators as Spark DataFrame plans."""

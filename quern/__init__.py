"""quern: retrieval analytics and training-data preparation as Spark plans."""

"""Web-corpus indexing, link analysis and ranked search as Spark DataFrame plans."""

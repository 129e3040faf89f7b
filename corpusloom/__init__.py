"""corpusloom: retrieval, search-result and corpus analytics as Spark plans."""

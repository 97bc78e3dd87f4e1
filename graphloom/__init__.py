"""Knowledge-graph, retrieval and evaluation queries as PySpark DataFrame programs."""

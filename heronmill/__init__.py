"""Heronmill: document ETL, hybrid retrieval and corpus analytics as Spark jobs."""

"""Lectern: corpus retrieval and grounded-answer analytics as Spark jobs."""

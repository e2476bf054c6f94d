"""Spark operators for analysing and curating corpora of grouped short texts."""

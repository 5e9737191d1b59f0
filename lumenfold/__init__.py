"""Paired-image fusion, image-quality metrics and the analysis of their results as Spark DataFrame jobs."""

"""Cluster usage accounting as Spark jobs: DataFrames in, DataFrames out."""

"""Pipelines assembled from operators, and the fixture views."""

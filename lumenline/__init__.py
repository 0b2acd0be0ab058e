"""Lecture-timeline analytics on Spark."""

"""Sketches over streams, and the same sketches over tables."""

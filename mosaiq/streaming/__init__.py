"""Matrices that grow with a stream."""

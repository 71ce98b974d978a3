"""Numpy kernels that run inside Arrow tasks, and scalar helpers."""

"""Choices made before a plan is built: strategy, rewriting, lineage."""

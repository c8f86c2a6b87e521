"""Spark analytics for prose: linting, review algebra and text tables."""

"""Stages, and queries over the driver's tables with their SQL."""

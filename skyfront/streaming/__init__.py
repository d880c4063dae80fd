"""Skylines over streams."""

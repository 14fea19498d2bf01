"""Wardrobe data jobs on Spark."""

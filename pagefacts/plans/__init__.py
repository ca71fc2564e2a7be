"""Whole jobs, and the staging they share."""

"""Whole queries over tables, and what they share."""

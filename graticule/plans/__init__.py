"""Whole plans made of operators, and the storage between their steps."""

"""Operators on pixel, signal, mask, score and segment tables."""

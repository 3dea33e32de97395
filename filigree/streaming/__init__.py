"""Streams of points against a fitted graph."""

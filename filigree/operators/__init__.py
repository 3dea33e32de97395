"""Operators over DataFrames: assignment, projection, neighbours, windows, paths, trajectories, editing."""

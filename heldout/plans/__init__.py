"""Compositions: one cell, experiment jobs, reports, views of the shared tables."""

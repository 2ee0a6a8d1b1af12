"""Spark jobs for particle-jet event analysis."""

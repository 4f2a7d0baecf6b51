"""Projection, snapshots, whole runs."""

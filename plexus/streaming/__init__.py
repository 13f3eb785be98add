"""Structured Streaming over voxel slices."""

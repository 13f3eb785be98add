"""Operators on voxel tables (x, y, z, v; zeros absent) and networks (vertex, edge, point tables)."""

"""Plan-level helpers: shared scratch tables and fixed-point loops."""

"""The graph model."""

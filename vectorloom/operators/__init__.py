"""DataFrame operators over vector tables."""

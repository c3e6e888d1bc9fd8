"""DataFrame operators of nearest-neighbour analytics."""

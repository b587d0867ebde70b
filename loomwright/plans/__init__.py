"""Step logs compiled into lazy plans."""

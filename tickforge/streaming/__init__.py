"""Operators over streams of bars, and resumption from saved state."""

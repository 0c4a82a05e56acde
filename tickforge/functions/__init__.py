"""Building blocks that operators share."""

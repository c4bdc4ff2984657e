"""DataFrame-to-DataFrame operators, all keyed by ``series`` (or user/farm)."""

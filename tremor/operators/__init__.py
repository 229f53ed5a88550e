"""DataFrame-to-DataFrame operators: mapping, quality, valuation, pivots, alerts."""

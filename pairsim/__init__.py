"""pairsim: sentence-pair tables on Spark (clean, augment, balance, score, blend)."""

__version__ = "0.1.0"

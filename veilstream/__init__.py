"""Privacy-preserving rewrites of keyed event streams, analysed and scored on Spark."""

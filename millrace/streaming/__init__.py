"""Sketches of streams: counts of ones in a sliding window, and fixed-size samples of texts."""

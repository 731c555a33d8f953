"""Scores of a modified stream: fidelity of results, of load, and privacy."""

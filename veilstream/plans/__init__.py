"""Pipelines of modifiers: their form, grammar, compilation, scoring and search."""

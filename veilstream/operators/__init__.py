"""Operators over streams: modifiers, sliding analysis, profiles."""

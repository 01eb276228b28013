"""Continuous form of the appended prediction log."""

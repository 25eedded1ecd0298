"""Operators for preparing training text at scale, each in its own module."""

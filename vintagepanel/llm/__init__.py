"""Operators for preparing training text at scale. Optional: the rest of the library does not import this."""

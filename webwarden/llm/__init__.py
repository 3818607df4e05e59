"""Operators for texts that train language models. Nothing outside this package imports it."""

"""Operators for preparing language-model training text at corpus scale.

Nothing outside this package imports it; deleting the folder leaves the rest of
the library whole.
"""

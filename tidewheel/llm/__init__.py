"""Operators for preparing training text: scoring, searching, matching, mixing and sharding.

Nothing else in the library imports this subpackage.
"""

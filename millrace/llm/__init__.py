"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; ``queries.py`` holds the registered queries and
``oracles.py`` their SQL.
"""

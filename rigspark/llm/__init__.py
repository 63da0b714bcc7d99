"""Operators for preparing text and page corpora for model training.

Nothing outside this subpackage imports it.  ``queries`` holds the registered queries and
``oracles`` their SQL.
"""

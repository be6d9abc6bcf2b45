"""Operators that prepare text for training language models.

Nothing outside this subpackage imports it.  Each module holds one operator; `queries` registers one query for each.
"""

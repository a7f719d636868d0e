"""Training-data operators: one module each, over ``documents``-like tables.

Nothing outside this subpackage imports it; ``queries.py`` holds the thin
``opN_<name>`` queries and the SQL that some of them can be held against.
"""

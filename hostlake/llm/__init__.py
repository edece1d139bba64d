"""Operators for preparing training corpora at scale, each a DataFrame-to-DataFrame function.

Nothing outside this subpackage imports it. ``registry`` lists the queries that
apply every operator, with production parameters, to its whole table.
"""

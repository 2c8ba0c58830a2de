"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface and the thin ``opN_<name>`` query over the tables.
"""

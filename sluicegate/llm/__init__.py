"""Operators for preparing training data at corpus scale.

Nothing else in the library imports this subpackage; it can be deleted as a
whole.  Each module is one operator with its own general interface;
``queries`` holds the registered ``opN_*`` queries and their SQL.
"""

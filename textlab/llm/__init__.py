"""Operators of a training-data pipeline at corpus scale.

Nothing else in the library imports this subpackage; it uses the library's general helpers
(``textlab.session``). Each module holds one operator with its own general interface; the
registered queries derive their digest columns from the operators' real outputs
(``queries.py``).
"""

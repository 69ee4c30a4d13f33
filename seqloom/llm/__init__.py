"""Operators for preparing language-model training text.

Nothing else in the library imports this subpackage.  Every operator module
has a general function (DataFrame in, DataFrame out) and a thin ``query`` that
applies it, with production parameters, to a whole table.
"""

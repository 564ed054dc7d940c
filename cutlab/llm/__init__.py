"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage; remove the folder and the
analytics part keeps working.
"""

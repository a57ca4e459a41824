"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; removing it leaves the rest of the
library working.
"""

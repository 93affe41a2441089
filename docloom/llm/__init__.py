"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Modules are imported
on demand; this file stays empty of imports so that Python workers load fast.
"""

"""Operators of a training-data pipeline at corpus scale.

Nothing outside this subpackage (and the top-level pipeline) imports it.
"""

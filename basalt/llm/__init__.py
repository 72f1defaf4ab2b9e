"""Operators of a large-scale text pipeline. Nothing outside this subpackage imports it."""

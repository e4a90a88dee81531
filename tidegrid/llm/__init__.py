"""Operators on text for language models. Nothing else of the package imports this one."""

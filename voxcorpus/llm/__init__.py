"""Operators for preparing training text.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only if it can be imported.
"""

"""Training-data operators: one module for each operator, queries in ``queries``.

Nothing outside this folder imports it.
"""

"""Training-data operators: thirteen corpus operators, their registered queries and SQL.

Nothing outside this package (and the top-level pipeline module) imports it.
"""

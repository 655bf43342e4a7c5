"""Training-data operators.

Nothing else in the library imports this subpackage; ``queries`` holds the registered
queries with their SQL and ``__spark_entry__`` adds them when the subpackage is there.
"""

"""remap - move relational data from an old schema to a new one with Spark.

Everything is a composition of DataFrame operators: key crosswalks, code
lookups, delimited code lists, tolerant parsing, staged reloads and the
reports over the run log.  See ``README.md`` for the map of modules.
"""

__version__ = "0.1.0"

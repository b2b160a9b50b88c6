"""millrace: a Spark-first engine for profiling, comparing and analysing large tables.

Every operator takes DataFrames plus a specification and returns a lazily
composed DataFrame; Catalyst chooses the physical plan.
"""

__version__ = "0.1.0"

"""millrace: a Spark-first analytics engine.

A thin semantic layer over Spark DataFrames and Spark SQL: Catalyst plans and
optimises, Tungsten executes; only semantics Spark lacks are added here.
"""

__version__ = "0.1.0"

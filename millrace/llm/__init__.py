"""Operators for large training-data pipelines.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and the names of its columns, returns a DataFrame and declares its result for
nulls, empty texts, ties, repeated rows and empty tables in its docstring.
"""

from millrace.plans.shipping import ship_by_value

ship_by_value()

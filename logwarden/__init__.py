"""logwarden: web access-log security analytics as Spark DataFrame transforms.

Every operator is a function that takes DataFrames and returns a DataFrame;
nothing here runs a job by itself unless its docstring says so.
"""

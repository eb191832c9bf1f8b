"""Graftline: agro-climate and evidence analytics over Spark DataFrames.

Every operator is a function from DataFrame to DataFrame (or Column to Column);
nothing in the library runs an action on the data it is given.
"""

"""Operators for large text-corpus preparation.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames, reads only the columns it names, and cuts lineage with tables
written to the shared folder in ``spark.checkpoint.dir``.
"""

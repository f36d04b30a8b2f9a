"""temblor: catalogs of point events in space and time, analysed on Spark.

Every operator is a plain function ``fn(df, ..., **params) -> DataFrame``.
Column names are parameters whose defaults are the canonical event columns of
:mod:`temblor.schemas`.
"""

__version__ = "0.1.0"

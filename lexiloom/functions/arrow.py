"""Functions of modules as Arrow-batched UDFs that need no session when they are made, and that executors import themselves."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def udf(module: str, name: str, schema: str, arrays: bool = False):
    """A function of columns that calls ``module.name`` on pandas series of whole batches; with ``arrays``, on Arrow's arrays, so no text of a batch becomes an object before its turn."""
    root = ROOT

    def run(*series):
        import importlib
        import sys

        if root not in sys.path:
            sys.path.insert(0, root)
        return getattr(importlib.import_module(module), name)(*series)

    def call(*columns):
        if arrays:
            return F.arrow_udf(run, schema, F.ArrowUDFType.SCALAR)(*columns)
        return F.pandas_udf(run, schema, F.PandasUDFType.SCALAR)(*columns)

    return call

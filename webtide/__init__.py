"""webtide — web-page corpora and fetch logs as Spark DataFrame operators.

Subpackages: ``functions`` (column functions), ``sources`` (readers, sinks,
derived fixture views), ``operators`` (gates, extraction, outcomes,
redirects, logs, chunks, extension hook), ``plans`` (composed jobs and the
query registry), ``streaming`` (Structured Streaming jobs), ``oracle``
(DuckDB twins of the SQL-expressible queries).
"""

__version__ = "0.1.0"

# Functions and classes of this package that travel to Python workers
# (mapInArrow / applyInPandasWithState closures) are pickled by value, so
# executors need no copy of the package on their path.
try:  # pragma: no cover - depends on the pyspark build
    import sys as _sys

    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # older cloudpickle: ship the package with --py-files
    pass

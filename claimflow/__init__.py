"""claimflow: Spark-native claim and policy document processing.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL expressions, so Catalyst sees one plan from
the parquet scan to the sink.
"""

import sys as _sys

from claimflow.session import get_spark

# Ship claimflow's functions and classes to Python workers by value, so
# mapInPandas stages run even where the package is not installed on the
# executors (or the workers do not share the driver's working directory).
try:
    from pyspark import cloudpickle as _cloudpickle
    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle: package must be installed
    pass

__all__ = ["get_spark"]

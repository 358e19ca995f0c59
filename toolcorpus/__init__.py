"""Spark-native operators for preparing and judging tool-calling corpora.

Every public operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function built from Spark SQL expressions; Arrow-batched Python is used only
where no built-in expression fits (token LCS, pretty JSON, sequence packing,
the caller-supplied predictor).
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value, so Python workers need no install of it."""
    import sys

    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_ship_by_value()

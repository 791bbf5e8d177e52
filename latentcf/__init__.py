"""latentcf — latent-class collaborative filtering on Spark DataFrames.

A probabilistic latent class model p(s|u) = sum_z p(z|u) p(s|z) is fitted by
expectation-maximisation over distinct user-item pairs, then used to score,
threshold, recommend and evaluate. Every step is a DataFrame plan that
Catalyst optimises; Python only drives the EM loop and, for the quadratic
all-pairs scoring, runs vectorised numpy inside Spark tasks.
"""

import sys as _sys

# Functions and classes of this package that run inside Spark tasks
# (mapInPandas block scorers, the vector-stats UDF) are pickled by value, so
# executors need numpy/pandas but not this package on their path.
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - very old pyspark: ship with --py-files instead
    pass

from latentcf.model import LatentClassModel  # noqa: E402

__all__ = ["LatentClassModel"]
__version__ = "0.1.0"

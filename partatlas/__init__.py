"""Spark jobs that analyse large parts catalogues."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

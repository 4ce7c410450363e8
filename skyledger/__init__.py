"""Catalogue analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from skyledger.session import build_session, tune, work_folder

# functions used inside tasks travel with the job, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "tune", "work_folder"]

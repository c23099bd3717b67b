"""Implicit-feedback recommendation on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from affinis.plans.baseline import baseline_factors, fit_baseline
from affinis.plans.prepare import Prepared, load_and_prepare, prepare
from affinis.plans.training import FactorModel, eals_train, eals_train_uniform

# Task functions travel with the job, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = [
    "FactorModel",
    "Prepared",
    "baseline_factors",
    "eals_train",
    "eals_train_uniform",
    "fit_baseline",
    "load_and_prepare",
    "prepare",
]

"""Operators of a training-data pipeline.

Functions shipped to executors are pickled by value, so that executors need
not have this package on their path.
"""

from pyspark import cloudpickle

import tarnbeck.llm as _self

cloudpickle.register_pickle_by_value(_self)

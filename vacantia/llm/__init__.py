"""Operators of a training-data pipeline: rules, deduplication, decontamination, scoring, tokens and archives.

Functions that run in tasks travel with the plan, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

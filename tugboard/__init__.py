"""Analytics for logs of several people sharing one control panel, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

from tugboard.config import PanelSettings

# The few functions that run in Python tasks travel with the task, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["PanelSettings"]

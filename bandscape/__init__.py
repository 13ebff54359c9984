"""Spectral raster analytics on Spark.

Archives of multispectral scans are tables: one row per pixel, keyed by
``scene_id``, ``y``, ``x``, one column per band.  Every operator is a function
from DataFrames to a DataFrame, so operators chain with ``df.transform``.
"""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

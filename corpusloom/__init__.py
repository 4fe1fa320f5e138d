"""corpusloom: a PySpark-native engine for preparing, labelling, scoring and reporting on page corpora."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

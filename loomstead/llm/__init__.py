"""Operators of a training-data pipeline over tables of documents and pages.

Nothing else in the library imports this subpackage. Its Python workers need
no installed copy of it: functions of the subpackage travel with the query.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""Operators for preparing training text; nothing else in the library imports this folder.

Code that runs inside tasks is shipped with the task, so executors need no copy
of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

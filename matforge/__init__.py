"""matforge: material forecasting and procurement planning as Spark jobs.

Every public operator is a ``DataFrame -> DataFrame`` function (or a column
expression) so Catalyst plans the work end to end; nothing is collected to the
driver except bounded, size-checked dimension tables.
"""

from matforge.config import PlanConfig

__all__ = ["PlanConfig"]
__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that tasks run travel with their code, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Earth-observation chip and embedding analytics as Spark DataFrame operators.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a ``Column``
expression) that declares a plan and leaves the physical strategy to Spark.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Worker-side helpers travel inside the task, so executors need no install.
register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

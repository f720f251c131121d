"""reportlake: report, label, image and instruction tables prepared on Spark.

Every public function takes and returns ``DataFrame`` or ``Column`` objects, so
a job stays one lazy plan until it is written.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions for Arrow batches travel whole, so executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

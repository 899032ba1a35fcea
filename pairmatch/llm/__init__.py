"""Operators for large training-data pipelines (see README, "Training-data operators").

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries
when it is present.
"""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: its functions travel with the tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

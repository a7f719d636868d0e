"""evigrain: building and querying a citable document corpus on Spark.

The package ships itself to executors by value (see ``_by_value``), so a
cluster needs no wheel or ``--py-files`` entry for it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

"""passagework: document chunking, embedding and semantic retrieval on Spark.

Everything is a plain ``DataFrame -> DataFrame`` function, so any step can be
used on its own with ``df.transform(...)`` or registered as a view.
"""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the query, so
# executors need numpy and pyarrow but not an installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"

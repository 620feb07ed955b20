"""fieldpulse: Spark jobs that turn free-text field reports into ranked emerging patterns."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their own code, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

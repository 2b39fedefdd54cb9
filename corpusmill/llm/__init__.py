"""Operations of a training-data pipeline; ``queries`` holds their registered forms."""

import sys

from pyspark import cloudpickle

# The functions that run in tasks travel whole: executors need not have this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

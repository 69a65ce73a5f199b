"""sparkloom: a PySpark-native analytics engine with strict, documented query semantics.

Its functions travel to the Python workers by value, so executors need no copy of the
package, and it works from any folder.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

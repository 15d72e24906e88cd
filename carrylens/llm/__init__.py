"""Training-data operators: fingerprints, packing, near-duplicates, licence
scans, repeat removal, personal data, benchmark decontamination, language
identification and page extraction.  Nothing else in the library imports
this subpackage."""

import sys

from pyspark import cloudpickle

# Tasks get these modules' functions by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

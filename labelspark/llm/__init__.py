"""Operators for training-data pipelines over raw text, pages and tokens.

Each module holds one operator with a general interface; ``queries`` registers
the thin ``opN_*`` queries over the given tables. Nothing outside this
subpackage (and ``corpus_pipeline``) imports it.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# executors need numpy, pyarrow and the tokenizer libraries, not this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

"""Operators that prepare training text: one module each, their registered queries in ``jobs``."""

import os
import sys
from pathlib import Path

from pyspark import cloudpickle

_home = Path(__file__).resolve().parents[2]
if _home not in [Path(p or ".").resolve() for p in ["", *os.environ.get("PYTHONPATH", "").split(os.pathsep)]]:
    # workers would not find the package by themselves, so its functions travel with the jobs
    cloudpickle.register_pickle_by_value(sys.modules[__name__])

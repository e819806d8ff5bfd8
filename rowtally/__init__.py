"""Reconcile two versions of a keyed table, or two folders of feeds, as Spark jobs."""

import sys

from pyspark import cloudpickle

from rowtally.plans.channels import compare_channels
from rowtally.plans.folders import compare_folders
from rowtally.plans.reconcile import Reconciliation, reconcile
from rowtally.session import working_session

# Python tasks carry the code they need, so executors work without a copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Reconciliation", "compare_channels", "compare_folders", "reconcile", "working_session"]

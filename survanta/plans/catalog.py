"""Imports every query module so that the registry is complete."""

from .registry import QUERIES, SQL  # noqa: F401
from . import survival_queries  # noqa: F401
from . import metric_queries  # noqa: F401
from . import adapter_queries  # noqa: F401
from . import standardize_queries  # noqa: F401
from . import ranking_queries  # noqa: F401
from . import retrieval_queries  # noqa: F401
from . import model_queries  # noqa: F401

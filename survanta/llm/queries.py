"""Imports every query module of this package so that the registry is complete."""

from .registry import QUERIES, SQL  # noqa: F401
from . import quality_queries  # noqa: F401
from . import toxicity_queries  # noqa: F401
from . import decontaminate_queries  # noqa: F401
from . import urlfilter_queries  # noqa: F401
from . import bpe_queries  # noqa: F401
from . import tokenfiles_queries  # noqa: F401
from . import secretscan_queries  # noqa: F401
from . import neardup_queries  # noqa: F401
from . import passages_queries  # noqa: F401
from . import mixing_queries  # noqa: F401
from . import runs_queries  # noqa: F401
from . import align_queries  # noqa: F401
from . import bytebpe_queries  # noqa: F401



from . import queries  # noqa: F401  (first: the other modules register with it)

"""All registered queries of the library, and their SQL."""

from hardwood.plans import extra, more, people, small, space  # noqa: F401
from hardwood.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]

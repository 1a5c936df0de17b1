"""Named queries over the driver's tables, each beside the SQL that checks it."""

from tidepanel.queries import aggregates, features, joins, models, reports, scalars, sets, streams, validation  # noqa: F401  modules register what they define
from tidepanel.queries.features import flagship  # noqa: F401
from tidepanel.queries.registry import ORACLE_SQL, QUERIES  # noqa: F401

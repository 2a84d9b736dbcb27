"""Every registered query, and the DuckDB SQL for those that SQL can express."""

from flowloom.catalog import alerting, dashboards, evaluation, flows, learning, streams, traffic  # noqa: F401
from flowloom.catalog.book import QUERIES, SQL  # noqa: F401

"""Error-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import errors as op
from quire.plans.tables import ERROR_LOG, error_log

QUERIES = {
    "error_groups": (
        lambda s, d: op.error_groups(error_log(s, d), limit=200),
        f"""WITH {ERROR_LOG} SELECT fingerprint, source, level, max(message) AS message, count(*) AS occurrences,
 sum(CASE WHEN status = 'new' THEN 1 ELSE 0 END)::BIGINT AS n_new, max(created_at) AS last_seen, min(created_at) AS first_seen,
 CASE WHEN sum(CASE WHEN status = 'new' THEN 1 ELSE 0 END) > 0 THEN 'new' ELSE 'handled' END AS status
 FROM error_log GROUP BY 1, 2, 3 ORDER BY last_seen DESC, fingerprint LIMIT 200""",
    ),
}

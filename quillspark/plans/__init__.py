"""Named queries over whole tables, and the SQL that says the same."""

from __future__ import annotations

from quillspark.plans.checking import ORACLE_SQL as _CHECK_SQL
from quillspark.plans.checking import QUERIES as _CHECK
from quillspark.plans.correcting import ORACLE_SQL as _CORRECT_SQL
from quillspark.plans.correcting import QUERIES as _CORRECT
from quillspark.plans.streams import ORACLE_SQL as _STREAM_SQL
from quillspark.plans.streams import QUERIES as _STREAM

QUERIES: dict = {**_CHECK, **_CORRECT, **_STREAM}
ORACLE_SQL: dict = {**_CHECK_SQL, **_CORRECT_SQL, **_STREAM_SQL}

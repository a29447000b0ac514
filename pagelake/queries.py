"""All registered queries but those of training data, which `__spark_entry__.py` adds."""

from __future__ import annotations

from pagelake.plans import more, native, web

QUERIES = native.QUERIES | web.QUERIES | more.QUERIES
ORACLE = native.ORACLE | web.ORACLE | more.ORACLE

"""The registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmere.plans import fields, relational, wiki, worlds  # noqa: F401  fields and worlds add to the queries of relational

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**wiki.QUERIES, **relational.QUERIES}
SQL: dict[str, str] = {**wiki.SQL, **relational.SQL}
flagship = relational.flagship

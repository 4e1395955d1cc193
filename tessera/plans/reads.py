"""Runs a read over frames that are given by name, without leaving a view behind."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import sqltext


def run(spark: SparkSession, text: str, frames: dict[str, Callable[[], DataFrame]], params: dict | None = None) -> DataFrame:
    """Spark's plan of a read over the frames that it names.

    Each frame is a view of a unique name while the text is analysed, so that views of the caller are neither
    read nor replaced. Names that are no frame are left to the session's catalog.
    """
    params = params or {}
    needed = sqltext.params_in(text)
    missing = needed - params.keys()
    if missing:
        raise ValueError(f"missing parameter ${sorted(missing)[0]}")
    ts = sqltext.tokens(text)
    known = {name.lower(): make for name, make in frames.items()}
    named = {sqltext.name_of(ts[i]).lower() for i in sqltext.table_references(ts)} & known.keys()
    views = {name: f"tessera_{uuid.uuid4().hex}" for name in named}
    try:
        for name, view in views.items():
            known[name]().createOrReplaceTempView(view)
        args = {k: params[k] for k in needed}
        sql = sqltext.to_spark(text, views=views)
        return spark.sql(sql, args=args) if args else spark.sql(sql)
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)

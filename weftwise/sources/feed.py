"""A change feed of persons: upserts and tombstones, merged by sequence number.

The kept table has a row a record, with the search keys of ``model.with_keys``, the number of the change that made it
(``seq``) and ``is_deleted``. Records that were deleted stay as tombstones, so a change that comes late is known to be
older. A batch is cut down to the newest change of each record first (an aggregate, however many changes one record has),
then to those that are newer than what is kept; only these get new search keys, all other rows pass as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.functions.text import blank
from weftwise.sources.model import with_keys


def newest(changes: DataFrame) -> DataFrame:
    """Of each record (source, id) the change with the largest ``seq``; of equal ones a tombstone, else the largest row.

    Changes without an id, source or seq are left out; nulls in text columns are empty strings.
    """
    text = [f.name for f in changes.schema if f.dataType.simpleString() == "string"]
    whole = changes.filter("id is not null and source is not null and seq is not null").withColumns({c: blank(F.col(c)) for c in text})
    whole = whole.withColumn("is_deleted", F.coalesce("is_deleted", F.lit(False)))
    rest = [c for c in whole.columns if c not in ("id", "source", "seq", "is_deleted")]
    top = whole.groupBy("source", "id").agg(F.max(F.struct("seq", "is_deleted", *rest)).alias("x"))
    return top.select("source", "id", "x.*").select(*whole.columns)


def start(persons: DataFrame, seq: int = 0) -> DataFrame:
    """The kept table of a first load; rows that are marked deleted are tombstones already."""
    return with_keys(newest(persons.withColumn("seq", F.lit(seq).cast("long"))))


def merge(kept: DataFrame, changes: DataFrame) -> DataFrame:
    """The kept table after a batch of changes, in any order and with repeats; a batch that is merged again changes nothing."""
    seen = kept.select("source", "id", F.col("seq").alias("known"))
    news = newest(changes).join(seen, ["source", "id"], "left").filter("known is null or seq > known").drop("known")
    untouched = kept.join(news.select("source", "id"), ["source", "id"], "left_anti")
    return untouched.select(*kept.columns).unionByName(with_keys(news).select(*kept.columns))


def current(kept: DataFrame) -> DataFrame:
    """Records that aren't deleted."""
    return kept.filter(~F.col("is_deleted"))

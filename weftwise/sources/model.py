"""Schemas, and the form in which records enter: no nulls, no deleted rows, folded search keys precomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwise.functions.text import blank, email_domain, normalize_a, normalize_b, utrim

DIRECTORY, HELPDESK = "directory", "helpdesk"
PERSON = "id string, xid string, source string, first_name string, last_name string, email string, office_phone string, mobile_phone string, other_phone string, phone_no string, org_code string, status string, is_deleted boolean"
EDGE = "out_id string, verb string, in_id string"
ACCOUNT = "id string, xid string, source string, status string"
STT = "struct<raw:string,nlp:string,tagged:string,slotted:string,structured:string>"
MATCH_REQUEST = f"request_id long, first {STT}, last {STT}, domains array<string>, last_name_hint string"
RESOLVE_REQUEST = "request_id long, phone string, name string, domains array<string>"


def read(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """A table in any of Spark's formats."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema else reader).load(path)


def visible(rows: DataFrame) -> DataFrame:
    """Without soft-deleted rows."""
    return rows.filter(~F.coalesce("is_deleted", F.lit(False))) if "is_deleted" in rows.columns else rows


def ingest(rows: DataFrame) -> DataFrame:
    """Visible rows with nulls of string columns as empty strings."""
    text = [f.name for f in rows.schema if f.dataType.simpleString() == "string"]
    return visible(rows).withColumns({c: blank(F.col(c)) for c in text})


def with_keys(person: DataFrame) -> DataFrame:
    """Persons with the columns that lookups search by: written with the table, they are plain columns to filter and join on."""
    first, last = F.col("first_name"), F.col("last_name")
    forms = lambda c: F.array_distinct(F.array(F.lower(utrim(c)), normalize_a(c), normalize_b(c)))
    return person.withColumns({
        "record_key": F.concat_ws(":", "source", "id"), "first_key": F.lower(first), "last_key": F.lower(last),
        "first_forms": forms(first), "last_forms": forms(last), "domain": email_domain(F.col("email")),
    })


def in_scope(person: DataFrame, org_code: str = "DG", status: str = "ACTIVE") -> DataFrame:
    """Helpdesk records count only in one organisation and while active."""
    return person.filter((F.col("source") == DIRECTORY) | ((F.col("org_code") == org_code) & (F.col("status") == status)))

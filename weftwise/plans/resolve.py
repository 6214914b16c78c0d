"""Resolve callers: each request's phone or name to one identity, or to why there is none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftwise.functions.text import blank, utrim
from weftwise.operators.cluster import best_of, clusters, cross_scopes, external_id, field_score, keyed_records, linked_across, linked_within, ranked
from weftwise.operators.components import FOLDED, folded_components, gathered, split_by_size
from weftwise.operators.graph import person_account
from weftwise.operators.lookup import DIRECTORY_PHONES, by_name, by_phone, domain_filter, first_hits
from weftwise.operators.work import dealt, parts_of, sent_if_few, settle
from weftwise.sources.model import DIRECTORY, HELPDESK
from weftwise.sources.settings import Settings

IDENTITY = ["status", "directory_id", "directory_xid", "helpdesk_id", "helpdesk_xid", "display_name", "email"]

#: What is looked at of the persons found.
_READ = ["record_key", "source", "id", "xid", "first_name", "last_name", "email", *DIRECTORY_PHONES, "phone_no"]


def candidates(requests: DataFrame, person: DataFrame, lookup_limit: int | None = None) -> DataFrame:
    """Persons found for each valid request, with ``by_phone`` telling how.

    With ``lookup_limit``, or that of the settings, only so many a request and source are looked at, before the domain filter.
    """
    lookup_limit = lookup_limit or Settings.of(person.sparkSession).limit
    requests = sent_if_few(requests)
    asked = requests.withColumns({"phone": blank(F.col("phone")), "name": utrim(F.col("name"))})
    asked = asked.filter((F.col("phone") == "") != (F.col("name") == ""))
    phone = by_phone(asked, person).withColumn("by_phone", F.lit(True))
    name = by_name(asked.filter("phone = ''"), person).withColumn("by_phone", F.lit(False))
    return domain_filter(first_hits(phone.unionByName(name), ["request_id", "source"], lookup_limit), requests)


_SHOWN = ["id", "xid", "name", "email"]


def _shown(r) -> list:
    return [r["id"], external_id(r["xid"], r["id"]), F.trim(F.concat_ws(" ", r["first_name"], r["last_name"])), r["email"]]


def facts_in_rows(found: DataFrame) -> DataFrame:
    """(request_id, d, h, same, directory_*, helpdesk_*): how many persons each source has, whether records of both are
    confirmed as the same, and each source's best record. All of a request is worked out in the row it is gathered to."""
    # a phone search already shares the phone, so there it links nothing
    rows = gathered(keyed_records(found, F.col("by_phone")).withColumn("__score", field_score()), ["request_id"])
    parts = folded_components(F.col("rows"), linked_within)
    count = lambda s: F.size(F.filter("parts", lambda g: g[0]["source"] == s))
    same = F.exists("rows", lambda a: F.exists("rows", lambda b: (a["source"] == DIRECTORY) & linked_across(a, b)))
    out = rows.select("request_id", "rows", parts.alias("parts")).select("request_id", count(DIRECTORY).alias("d"), count(HELPDESK).alias("h"), same.alias("same"), best_of(F.col("rows"), DIRECTORY).alias("x"), best_of(F.col("rows"), HELPDESK).alias("y"))
    sides = [F.when(F.col(r).isNotNull(), c).alias(f"{s}_{name}") for s, r in ((DIRECTORY, "x"), (HELPDESK, "y")) for name, c in zip(_SHOWN, _shown(F.col(r)), strict=True)]
    return out.select("request_id", "d", "h", "same", *sides)


def facts_by_joins(found: DataFrame) -> DataFrame:
    """As ``facts_in_rows``, for requests with any number of records.

    No request comes together in one task: its persons are dealt by cluster, and of each only the best record goes on.
    """
    scope = ["request_id"]
    grouped = settle(clusters(found, scope, exclude_phone=F.col("by_phone"), folded=0))
    record = F.struct("id", "xid", "first_name", "last_name", "email", field_score().alias("__score"))
    own = [*scope, "source", "cluster"]
    people = dealt(grouped.select(*own, record.alias("r")), parts_of(grouped.count()), *own).groupBy(*own).agg(F.min(ranked(F.col("r"))).alias("best"))
    of = lambda s, c: F.when(F.col("source") == s, F.col(c))
    both = ((DIRECTORY, "d", "x"), (HELPDESK, "h", "y"))
    counts = people.groupBy(*scope).agg(*[F.count(of(s, "cluster")).alias(n) for s, n, _ in both], *[F.min(of(s, "best")).alias(r) for s, _, r in both])
    confirmed = cross_scopes(found, scope).withColumn("same", F.lit(True))
    joined = counts.join(confirmed, "request_id", "left").withColumn("same", F.coalesce("same", F.lit(False)))
    sides = [F.when(F.col(r).isNotNull(), c).alias(f"{s}_{name}") for s, _, r in both for name, c in zip(_SHOWN, _shown(F.col(r)["r"]), strict=True)]
    return joined.select("request_id", "d", "h", "same", *sides)


def resolve(requests: DataFrame, person: DataFrame, lookup_limit: int | None = None, folded: int = FOLDED) -> DataFrame:
    """A row for each request: status ok, ambiguous, not_found or bad_request, and the identity if ok.

    Exactly one of phone and name must be given. More than one person in a source is ambiguous, and so are one
    in each source that no pair of records confirms as the same. Requests that find up to ``folded`` records are
    decided in one row each, the others by joins.
    """
    few, many = split_by_size(settle(candidates(requests, person, lookup_limit).select("request_id", "by_phone", *_READ)), ["request_id"], folded)
    made = ([] if few is None else [facts_in_rows(few)]) + ([] if many is None else [facts_by_joins(many)])
    facts = made[0] if len(made) == 1 else made[0].unionByName(made[1])
    all_ = requests.select("request_id", ((blank(F.col("phone")) == "") == (utrim(F.col("name")) == "")).alias("bad"))
    joined = all_.join(facts, "request_id", "left")
    d, h = F.coalesce("d", F.lit(0)), F.coalesce("h", F.lit(0))
    status = (
        F.when(F.col("bad"), "bad_request").when((d > 1) | (h > 1), "ambiguous").when((d == 1) & (h == 1) & ~F.col("same"), "ambiguous")
        .when((d == 0) & (h == 0), "not_found").otherwise("ok")
    )
    either = lambda c: F.coalesce(F.nullif(f"directory_{c}", F.lit("")), F.col(f"helpdesk_{c}"), F.col(f"directory_{c}"))
    out = joined.withColumns({"status": status, "display_name": either("name"), "email": either("email")})
    return out.select("request_id", "status", *[F.when(F.col("status") == "ok", F.col(c)).alias(c) for c in IDENTITY[1:]])


def with_account(identities: DataFrame, edges: DataFrame, accounts: DataFrame) -> DataFrame:
    """What a caller is told: the identity with the directory person's account; without one its fields are null."""
    people = identities.filter("directory_id is not null").select(F.col("directory_id").alias("person_id")).distinct()
    own = person_account(people, edges, accounts).select(F.col("person_id").alias("directory_id"), "account_xid", "account_status")
    return identities.join(own, "directory_id", "left").select(*identities.columns, "account_xid", "account_status")

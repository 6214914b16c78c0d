"""One-hop steps over edges: a person's tickets and account, ticket lookup by any id, ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftwise.operators.cluster import external_id
from weftwise.operators.traverse import IN, OUT, Step, traverse

INCOMING, OUTGOING = ("affects", "assignedTo"), ("opens",)
#: From a person to its tickets, from a ticket to its persons, from a person to its accounts.
TO_TICKETS = Step((*((IN, v) for v in INCOMING), *((OUT, v) for v in OUTGOING)))
TO_PERSONS = Step((*((OUT, v) for v in INCOMING), *((IN, v) for v in OUTGOING)))
TO_ACCOUNTS = Step(((IN, "connects"),))


def ticket_links(edges: DataFrame) -> DataFrame:
    """(person_id, ticket_id) over the three verbs, each pair once."""
    into = edges.filter(F.col("verb").isin(*INCOMING)).select(F.col("in_id").alias("person_id"), F.col("out_id").alias("ticket_node"))
    out = edges.filter(F.col("verb").isin(*OUTGOING)).select(F.col("out_id").alias("person_id"), F.col("in_id").alias("ticket_node"))
    return into.union(out).distinct()


def ticket_view(tickets: DataFrame) -> DataFrame:
    """What is shown of a ticket: the clean description if there is one."""
    clean = F.when(F.col("clean_description") != "", F.col("clean_description")).otherwise(F.col("description"))
    return tickets.withColumn("description", clean).withColumn("xid", external_id(F.col("xid"), F.col("id"))).drop("clean_description")


def person_tickets(persons: DataFrame, edges: DataFrame, tickets: DataFrame) -> DataFrame:
    """Tickets of each person (person_id); links to no ticket are left to ``dangling_edges``."""
    starts = persons.select(F.col("person_id").alias("request_id"), F.col("person_id").alias("node"))
    links = traverse(starts, edges, [TO_TICKETS]).select(F.col("request_id").alias("person_id"), F.col("node").alias("ticket_node"))
    return links.join(ticket_view(tickets).withColumnRenamed("id", "ticket_node"), "ticket_node")


def dangling_edges(edges: DataFrame, tickets: DataFrame) -> DataFrame:
    return ticket_links(edges).join(tickets.select(F.col("id").alias("ticket_node")), "ticket_node", "left_anti")


def ticket_by_any_id(requests: DataFrame, tickets: DataFrame) -> DataFrame:
    """(request_id, key) to the first ticket by external id, then ticket id, then node id."""
    ids = F.array(*[F.struct(F.lit(n).alias("prio"), F.col(c).alias("key")) for n, c in enumerate(("ext_id", "ticket_id", "id"), 1)])
    listed = tickets.select("*", F.inline(ids)).filter("key != ''")
    first = Window.partitionBy("request_id").orderBy("prio", "id")
    return requests.join(listed, "key").withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth", "prio")


def owned_tickets(requests: DataFrame, edges: DataFrame, tickets: DataFrame) -> DataFrame:
    """``ticket_by_any_id`` for requests with a person_id, only if the ticket is that person's."""
    found = ticket_by_any_id(requests, tickets)
    mine = ticket_links(edges).select("person_id", F.col("ticket_node").alias("id"))
    return found.join(mine, ["person_id", "id"], "left_semi")


def person_account(persons: DataFrame, edges: DataFrame, accounts: DataFrame, source: str = "directory") -> DataFrame:
    """Each person (person_id) with its connected account of the source, the lowest id if several, else nulls."""
    starts = persons.select(F.col("person_id").alias("request_id"), F.col("person_id").alias("node"))
    reached = traverse(starts, edges, [TO_ACCOUNTS]).withColumnRenamed("node", "id")
    own = accounts.filter(F.col("source") == source).select("id", external_id(F.col("xid"), F.col("id")).alias("account_xid"), F.col("status").alias("account_status"))
    first = reached.join(own, "id").groupBy(F.col("request_id").alias("person_id")).agg(F.min(F.struct("id", "account_xid", "account_status")).alias("x"))
    return persons.join(first.select("person_id", F.col("x.id").alias("account_id"), "x.account_xid", "x.account_status"), "person_id", "left")

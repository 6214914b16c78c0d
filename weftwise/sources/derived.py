"""Person, ticket, edge, account and intent tables derived from the star-schema test data.

Each derivation is one SQL text in a small common dialect, so that another engine can build the same rows:
``{div}`` is integer division and ``{pick:NAME:index}`` an element of a list of names, counted from 0.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from weftwise.sources.model import in_scope, ingest, with_keys
from weftwise.sources.settings import Settings

FIRST = ["Maik", "Mike", "Marek", "Stefan", "Stephan", "Thomas", "Tomas", "Jörg", "Kathrin", "Katrin", "Paul", "Anna"]
LAST = ["Sellner", "Selner", "Meyer", "Maier", "Müller", "Mueller", "Weiß-Krüger", "Lander", "Lehmann", "Kellner", "Carl", "Karl"]
DOMAIN = ["a.example.com", "b.example.com", "c.example.net"]
LISTS = {"FIRST": FIRST, "LAST": LAST, "DOMAIN": DOMAIN}

TABLES = {
    "person": """
        select concat('c-', k) as id, case when k % 4 = 0 then concat('CX', k) else '' end as xid, 'directory' as source,
               case when k % 31 = 4 then '' else {pick:FIRST:g % 12} end as first_name, {pick:LAST:(g {div} 12) % 12} as last_name,
               case when k % 3 in (0, 1) or g % 2 = 0 then concat('p', g, '@', {pick:DOMAIN:(g {div} 144) % 3}) else '' end as email,
               case when k % 3 in (1, 2) then concat('+4900', lpad(cast(g as varchar(20)), 6, '0')) else '' end as office_phone,
               case when g % 5 = 1 then concat('+4922', lpad(cast(g as varchar(20)), 6, '0')) else '' end as mobile_phone,
               case when g % 7 = 2 then concat('+4933', lpad(cast(g {div} 2 as varchar(20)), 6, '0')) when g % 7 = 3 then '0' else '' end as other_phone,
               '' as phone_no, '' as org_code, '' as status, k % 17 = 11 as is_deleted
        from (select c_custkey as k, c_custkey {div} 3 as g from customer) c
        union all
        select concat('s-', k), case when k % 3 = 0 then concat('SX', k) else '' end, 'helpdesk',
               case when k % 23 = 9 then '' else {pick:FIRST:g % 12} end, {pick:LAST:(g {div} 12) % 12},
               case when k % 2 = 1 then '' when g % 8 = 4 then concat('p', g, '@x.example.org') else concat('p', g, '@', {pick:DOMAIN:(g {div} 144) % 3}) end,
               case when g % 6 = 5 then concat('+4944', lpad(cast(g as varchar(20)), 6, '0')) else '' end, '', '',
               case when k % 4 = 1 then '0' when g % 8 = 2 then concat('+4911', lpad(cast(g as varchar(20)), 6, '0')) else concat('+4900', lpad(cast(g as varchar(20)), 6, '0')) end,
               case when k % 7 = 0 then 'XX' else 'DG' end, case when k % 10 = 0 then 'INACTIVE' else 'ACTIVE' end, k % 13 = 6
        from (select s_suppkey as k, s_suppkey {div} 2 as g from supplier) s""",
    "ticket": """
        select concat('t-', o_orderkey) as id, concat('TX', o_orderkey) as xid, concat('E', o_orderkey) as ext_id, concat('T', o_orderkey {div} 2) as ticket_id,
               concat('order ', o_orderkey) as subject, concat('raw ', o_orderkey) as description,
               case when o_orderkey % 2 = 1 then '' else concat('clean ', o_orderkey) end as clean_description,
               o_orderstatus as status, o_orderpriority as priority, cast(cast(o_orderdate as date) as varchar(20)) as created_at
        from orders""",
    "edge": """
        select case l_linenumber when 3 then concat('c-', o_custkey) else concat('t-', l_orderkey) end as out_id,
               case l_linenumber when 1 then 'affects' when 2 then 'assignedTo' when 3 then 'opens' else 'relates' end as verb,
               case l_linenumber when 3 then concat('t-', l_orderkey + case when l_partkey % 50 = 0 then 100000000 else 0 end) else concat('c-', o_custkey) end as in_id
        from lineitem join orders on l_orderkey = o_orderkey""",
    "account": """
        select concat('a-', c_custkey) as id, case when c_custkey % 2 = 0 then concat('AX', c_custkey) else '' end as xid,
               case when c_mktsegment in ('BUILDING', 'AUTOMOBILE', 'MACHINERY') then 'directory' else 'foreign' end as source,
               case when c_custkey % 5 = 0 then 'DISABLED' else 'ENABLED' end as status
        from customer""",
    "connects": """
        select concat('a-', c_custkey) as out_id, 'connects' as verb, concat('c-', c_custkey) as in_id from customer where c_custkey % 3 <> 2
        union all select concat('a-', c_custkey + 1), 'connects', concat('c-', c_custkey) from customer where c_custkey % 4 = 0""",
    "probe": """
        select s_suppkey as request_id, lower(substr({pick:FIRST:s_suppkey % 12}, 1, 1 + s_suppkey % 3)) as first_prefix, lower(substr({pick:LAST:(s_suppkey {div} 5) % 12}, 1, 1 + (s_suppkey {div} 3) % 3)) as last_prefix,
               lower(substr({pick:LAST:(s_suppkey {div} 2) % 12}, 2, 3 + s_suppkey % 2)) as last_suffix
        from supplier""",
    "intent": """
        select concat('i-', p_partkey) as id, p_type as intent_type, p_name as description,
               concat('/v1,', case when p_partkey % 3 = 0 then '' else '/v2' end, ', /v3 ,/v', p_partkey % 4) as variable_names,
               concat(p_partkey % 7, ', ', p_brand, case when p_partkey % 5 = 0 then '' else concat(',', p_size) end) as variable_values
        from part""",
}


def _change(seq: int, where: str, deleted: str = "false", **other: str) -> str:
    columns = ["id", "xid", "source", "first_name", "last_name", "email", "office_phone", "mobile_phone", "other_phone", "phone_no", "org_code", "status"]
    shown = ", ".join(f"{other[c]} as {c}" if c in other else c for c in columns)
    return f"select {shown}, {deleted} as is_deleted, cast({seq} as bigint) as seq from ({TABLES['person']}) p where {where.replace('#', 'cast(substr(id, 3) as int)')}"


#: Two batches of changes: new addresses and deletions; then what comes late, what comes back and what is new.
TABLES["changes_1"] = " union all ".join([_change(5, "# % 5 = 0", email="concat('n', email)"), _change(7, "# % 7 = 0", "true"), _change(4, "# % 10 = 0", email="'old@x.example'")])
TABLES["changes_2"] = " union all ".join([
    _change(3, "# % 5 = 0", email="'late@x.example'"), _change(6, "# % 14 = 0", office_phone="'+49666'"), _change(9, "# % 21 = 0", last_name="'Zurück'"), _change(2, "# % 11 = 0", id="concat(id, '-new')"),
])


def sql(name: str, dialect: str = "spark") -> str:
    """The derivation of one table for ``spark`` or ``duckdb``."""

    def pick(m: re.Match) -> str:
        items = ", ".join(f"'{x}'" for x in LISTS[m[1]])
        return f"element_at(array({items}), cast(({m[2]}) + 1 as int))" if dialect == "spark" else f"list_extract([{items}], ({m[2]}) + 1)"

    div = "div" if dialect == "spark" else "//"
    return re.sub(r"\{pick:(\w+):([^}]*)\}", pick, TABLES[name].replace("{div}", div))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source = ("customer", "supplier", "orders", "lineitem", "part", "nation", "events")
    text = sql(name)
    for t in source:
        text = re.sub(rf"\b(from|join) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def persons(spark: SparkSession, sf_dir: str, settings: Settings | None = None) -> DataFrame:
    """Both sources, ingested, in the scope of the settings, with their search keys.

    The tables they come from are small files, so rows are dealt out before the keys are worked out.
    """
    settings = settings or Settings.of(spark)
    return with_keys(in_scope(ingest(table(spark, sf_dir, "person")), settings.org_code, settings.status).repartition("id"))

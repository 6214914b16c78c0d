"""Every operator as a query over the test tables, with the SQL that it must equal (DuckDB's dialect)."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwise.functions import aliases, phonetic, registry, similarity, text
from weftwise.operators import attributes, cluster, components, graph, incremental, lookup, nodes, traverse
from weftwise.operators.work import parts_of, settle, shared_folder
from weftwise.plans import match as matching
from weftwise.plans import resolve as resolving
from weftwise.sources import derived, feed
from weftwise.sources import nodes as node_table
from weftwise.sources.index import PersonIndex
from weftwise.sources.model import ACCOUNT, DIRECTORY, EDGE, HELPDESK, read
from weftwise.streaming import polling, serve

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- SQL building blocks (DuckDB)

_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def _trim(c: str) -> str:
    return _TRIM.format(c)


def _letters(c: str) -> str:
    return f"trim(regexp_replace({c}, '[^a-zA-Z]+', ' ', 'g'))"


def _a(c: str) -> str:
    return _letters(f"replace(replace(replace(replace(lower({_trim(c)}), 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'ß', 'ss')")


def _b(c: str) -> str:
    return _letters(f"replace(translate(lower({_trim(c)}), 'äöü', 'aou'), 'ß', 'ss')")


def _koelner(c: str) -> str:
    """Cologne phonetics of a column that holds variant B."""
    s = f"regexp_replace(upper({c}), '[^A-Z]', '', 'g')"
    one = (
        "case when x in ('A','E','I','J','O','U','Y') then '0' when x = 'H' then '' when x = 'B' then '1' when x = 'P' then case when n = 'H' then '3' else '1' end "
        "when x in ('D','T') then case when n in ('C','S','Z') then '8' else '2' end when x in ('F','V','W') then '3' when x in ('G','K','Q') then '4' "
        "when x = 'C' and p = '' then case when n in ('A','H','K','L','O','Q','R','U','X') then '4' else '8' end when x = 'C' and p in ('S','Z') then '8' "
        "when x = 'C' then case when n in ('A','H','K','O','Q','U','X') then '4' else '8' end when x = 'X' then case when p in ('C','K','Q') then '8' else '48' end "
        "when x = 'L' then '5' when x in ('M','N') then '6' when x = 'R' then '7' else '8' end"
    )
    for name, at in (("x", "i"), ("n", "i + 1"), ("p", "i - 1")):
        piece = f"case when {at} between 1 and length({s}) then substr({s}, {at}, 1) else '' end"
        one = re.sub(rf"\b{name} (=|in)", rf"({piece}) \1", one)
    code = f"array_to_string(list_transform(range(1, length({s}) + 1), lambda i : {one}), '')"
    for d in range(9):
        code = f"regexp_replace({code}, '{d}+', '{d}', 'g')"
    return f"(select substr(z, 1, 1) || replace(substr(z, 2), '0', '') from (select {code} as z))"


def _ratio(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 0.0::double else greatest(0.0::double, 1.0::double - levenshtein({a}, {b})::double / greatest(length({a}), length({b}))) end)"


def _person(*extra: str) -> str:
    """The persons in scope with their keys, as common table expressions."""
    return f"""
with recursive all_person as ({derived.sql("person", "duckdb")}),
person as (select *, source || ':' || id as record_key, lower(first_name) as first_key, lower(last_name) as last_key,
  {_a("first_name")} as fa, {_b("first_name")} as fb, {_a("last_name")} as la, {_b("last_name")} as lb,
  case when instr(email, '@') > 0 then lower(regexp_replace(email, '^.*@', '')) else '' end as domain
  from all_person where not is_deleted and (source = 'directory' or (org_code = 'DG' and status = 'ACTIVE'))){"".join(", " + x for x in extra)}
"""


_WORDS = r"select distinct unnest(string_split_regex(text, '[ \n]+')) as word from documents where text is not null"


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")
    return docs.filter("text is not null").select(F.explode(F.split("text", r"[ \n]+")).alias("word")).distinct()


# ---------------------------------------------------------------- scalar functions


@query(f"select word, {_a('word')} as norm_a, {_b('word')} as norm_b from ({_WORDS})")
def normalize_words(spark, sf_dir):
    w = F.col("word")
    return _words(spark, sf_dir).select("word", text.normalize_a(w).alias("norm_a"), text.normalize_b(w).alias("norm_b"))


@query(f"select norm, {_koelner('norm')} as code from (select distinct {_b('word')} as norm from ({_WORDS}))")
def koelner_words(spark, sf_dir):
    norm = _words(spark, sf_dir).select(text.normalize_b(F.col("word")).alias("norm")).distinct()
    return norm.select("norm", phonetic.koelner(F.col("norm")).alias("code"))


@query(r"select page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) as digest from pages")
def strip_tags_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    return pages.select("page_id", F.md5(text.strip_tags(F.col("html"))).alias("digest"))


@query("select p_partkey, case when p_partkey % 10 < 6 then nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda x : x <> ''), ' '), '') end as words from part")
def structured_words(spark, sf_dir):
    """Arrays of words; four in ten are broken, no array, of the wrong type or empty."""
    words = F.transform(F.split("p_name", " "), lambda w: F.struct(w.alias("word"), F.lit(0.9).alias("confidence")))
    tenth, broken = F.col("p_partkey") % 10, ['[{"word":"x"', '{"word":"x"}', '[{"word":5}]', "[]"]
    odd = F.get(F.lit(broken), (tenth - 6).cast("int"))
    raw = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.when(tenth < 6, F.to_json(words)).otherwise(odd).alias("raw"))
    return raw.select("p_partkey", text.structured_words(F.col("raw")).alias("words"))


_PARTS = "select a.p_partkey, case when a.p_partkey % 50 = 0 then '' else a.p_name || a.p_type end as t, case when b.p_partkey % 25 = 1 then '' else b.p_name || b.p_type end as u from part a join part b on b.p_partkey = a.p_partkey + 1"


@query(f"select p_partkey, t, u, {_ratio('t', 'u')} as ratio from ({_PARTS})")
def fuzzy_ratio_parts(spark, sf_dir):
    """Each part's name against the next one's; some are empty, on one side or both."""
    key, named = F.col("p_partkey"), F.concat("p_name", "p_type")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    t = part.select(key, F.when(key % 50 == 0, "").otherwise(named).alias("t"))
    u = part.select((key - 1).alias("p_partkey"), F.when(key % 25 == 1, "").otherwise(named).alias("u"))
    return t.join(u, "p_partkey").select("p_partkey", "t", "u", similarity.fuzzy_ratio(F.col("t"), F.col("u")).alias("ratio"))


_QUALITY = f"""
with all_person as ({derived.sql("person", "duckdb")}),
pairs as (select h.id, h.last_name as heard, d.last_name as stored, {_a('h.last_name')} as ha, {_b('h.last_name')} as hb, {_a('d.last_name')} as sa, {_b('d.last_name')} as sb from all_person h join all_person d on h.source = 'helpdesk' and d.id = 'c-' || substr(h.id, 3)),
q as (select id, heard, stored, least(1.0::double, greatest({_ratio('ha', 'sa')}, {_ratio('ha', 'sb')}, {_ratio('hb', 'sa')}, {_ratio('hb', 'sb')}) + case when hb <> '' and sb <> '' and {_koelner('hb')} = {_koelner('sb')} then 0.35::double else 0.0::double end) as quality from pairs)
select id, heard, stored, quality, cast(floor(50.0::double * (0.35::double * 1.0::double + 0.65::double * quality) + 0.5::double) as int) as stage from q"""


@query(_QUALITY)
def match_quality_pairs(spark, sf_dir):
    """Each helpdesk record's last name against that of the directory record of the same number."""
    people = derived.table(spark, sf_dir, "person").select("id", "source", "last_name", F.substring("id", 3, 20).alias("k"))
    heard, stored = people.filter(F.col("source") == HELPDESK).select("k", "id", F.col("last_name").alias("heard")), people.filter(F.col("source") == DIRECTORY).select("k", F.col("last_name").alias("stored"))
    q = heard.join(stored, "k").select("id", "heard", "stored", similarity.match_quality(F.col("heard"), F.col("stored")).alias("quality"))
    return q.withColumn("stage", similarity.stage_points(F.lit(1.0), F.col("quality")))


@query(_person() + "select domain, count(*) as persons from person group by domain")
def email_domain_persons(spark, sf_dir):
    return derived.persons(spark, sf_dir).groupBy("domain").agg(F.count(F.lit(1)).alias("persons"))


@query(_person() + r"select record_key, string_split(n, ' ')[1] as first, case when instr(n, ' ') > 0 then trim(substr(n, instr(n, ' ') + 1)) else '' end as last from (select record_key, trim(first_name || '  ' || last_name || case when record_key like '%7' then ' van Dyk ' else '' end) as n from person)")
def split_name(spark, sf_dir):
    """Names of one, two and more words, with spaces around."""
    name = F.concat(F.col("first_name"), F.lit("  "), F.col("last_name"), F.when(F.col("record_key").endswith("7"), " van Dyk ").otherwise(""))
    return derived.persons(spark, sf_dir).select("record_key", text.split_first(name).alias("first"), text.split_last(name).alias("last"))


_MERGED = " union all ".join(["select *, 1::bigint as seq from (" + derived.sql("person", "duckdb") + ")", derived.sql("changes_1", "duckdb"), derived.sql("changes_2", "duckdb")])


@query(f"select source || ':' || id as record_key, email, office_phone, lower(last_name) as last_key, case when instr(email, '@') > 0 then lower(regexp_replace(email, '^.*@', '')) else '' end as domain, seq from (select * from ({_MERGED}) qualify row_number() over (partition by source, id order by seq desc) = 1) where not is_deleted")
def persons_after_changes(spark, sf_dir):
    """Persons after two batches of changes: updates, deletions, late changes, records that come back and new ones."""
    kept = feed.start(derived.table(spark, sf_dir, "person"), 1)
    for batch in ("changes_1", "changes_2"):
        kept = settle(feed.merge(kept, derived.table(spark, sf_dir, batch)))
    return feed.current(kept).select("record_key", "email", "office_phone", "last_key", "domain", "seq")


# ---------------------------------------------------------------- requests

#: Phones of all kinds for the first groups, each asked for without and with a domain; names likewise.
def _resolve_requests(spark: SparkSession, kind: str, domain: str = "") -> DataFrame:
    if kind == "phone":
        i = F.col("id")
        kind_of = lambda *values: F.when(i < 80, values[0]).when(i < 140, values[1]).when(i < 180, values[2]).when(i < 220, values[3]).otherwise(values[4])
        number = (i - kind_of(*map(F.lit, (0, 80, 140, 180, 220)))).cast("string")
        rows = spark.range(260).select(i.alias("request_id"), F.concat(kind_of("+4900", "+4911", "+4922", "+4933", "+4944"), F.lpad(number, 6, "0")).alias("phone"), F.lit("").alias("name"))
    else:
        names = [f"{f} {x}" for f in derived.FIRST for x in derived.LAST]
        rows = spark.createDataFrame([(i, "", n) for i, n in enumerate(names)] + [(900, "", ""), (901, "+4900000001", "Maik Sellner")], "request_id long, phone string, name string")
    return rows.withColumn("domains", text.parse_list(F.lit(domain), lower=True))


_PHONES = (
    "requests as (select i as request_id, case when i < 80 then '+4900' when i < 140 then '+4911' when i < 180 then '+4922' when i < 220 then '+4933' else '+4944' end "
    "|| lpad((i - case when i < 80 then 0 when i < 140 then 80 when i < 180 then 140 when i < 220 then 180 else 220 end)::varchar, 6, '0') as phone, '' as name from range(260) r(i))"
)
_NAMES = (
    "requests as (select (f.i * 12 + l.i)::bigint as request_id, '' as phone, f.n || ' ' || l.n as name from "
    + f"(select unnest(range(12)) as i, unnest([{', '.join(repr(x) for x in derived.FIRST)}]) as n) f cross join (select unnest(range(12)) as i, unnest([{', '.join(repr(x) for x in derived.LAST)}]) as n) l "
    + "union all select 900, '', '' union all select 901, '+4900000001', 'Maik Sellner')"
)
_FOUND = """found as (select distinct r.request_id, p.*, r.phone <> '' as by_phone from requests r join person p on
  (r.phone <> '' and r.name = '' and ((p.source = 'directory' and r.phone in (p.office_phone, p.mobile_phone, p.other_phone)) or (p.source = 'helpdesk' and r.phone in (p.phone_no, p.office_phone))))
  or (r.phone = '' and r.name <> '' and p.first_key = lower(string_split(r.name, ' ')[1]) and p.last_key = lower(substr(r.name, instr(r.name, ' ') + 1))) where {0})"""
_SAME = """case when d.email <> '' and h.email <> '' then lower(d.email) = lower(h.email)
  when h.phone_no <> '' and (d.office_phone <> '' or d.mobile_phone <> '' or d.other_phone <> '') then h.phone_no in (d.office_phone, d.mobile_phone, d.other_phone)
  else lower(d.first_name) = lower(h.first_name) and lower(d.last_name) = lower(h.last_name) end"""
_LINKED = """(a.email <> '' and lower(a.email) = lower(b.email)) or ({0} and a.source = 'directory' and list_has_any(list_filter([a.office_phone, a.mobile_phone, a.other_phone], lambda x : x not in ('', '0')), [b.office_phone, b.mobile_phone, b.other_phone]))
  or ({0} and a.source = 'helpdesk' and a.phone_no not in ('', '0') and a.phone_no = b.phone_no)"""
_FIELDS = "case when source = 'directory' then (email <> '')::int + (office_phone <> '')::int + (mobile_phone <> '')::int + (other_phone <> '')::int + (first_name <> '')::int + (last_name <> '')::int else (email <> '')::int + (phone_no <> '')::int + (first_name <> '')::int + (last_name <> '')::int end"
_BEST = "row_number() over (partition by {0} order by (xid <> '') desc, " + _FIELDS + " desc, id asc)"


def _lookup_sql(requests: str, source: str) -> str:
    return _person(requests, _FOUND.format("true")) + f"select request_id, record_key from found where source = '{source}'"


@query(_lookup_sql(_PHONES, DIRECTORY))
def lookup_phone_directory(spark, sf_dir):
    return lookup.by_phone(_resolve_requests(spark, "phone"), derived.persons(spark, sf_dir)).filter(F.col("source") == DIRECTORY).select("request_id", "record_key")


@query(_lookup_sql(_PHONES, HELPDESK))
def lookup_phone_helpdesk(spark, sf_dir):
    return lookup.by_phone(_resolve_requests(spark, "phone"), derived.persons(spark, sf_dir)).filter(F.col("source") == HELPDESK).select("request_id", "record_key")


@query(_person(_NAMES, _FOUND.format("true")) + "select request_id, record_key from found")
def lookup_name_exact(spark, sf_dir):
    asked = _resolve_requests(spark, "name").filter("phone = '' and name != ''")
    return lookup.by_name(asked, derived.persons(spark, sf_dir)).select("request_id", "record_key")


@query(_person(_NAMES, _FOUND.format("p.domain in ('b.example.com', 'c.example.net')")) + "select request_id, record_key from found")
def domain_filter(spark, sf_dir):
    asked = _resolve_requests(spark, "name", " B.example.com , c.example.net,, ").filter("phone = '' and name != ''")
    return lookup.domain_filter(lookup.by_name(asked, derived.persons(spark, sf_dir)), asked).select("request_id", "record_key")


@query(_person(_NAMES, _FOUND.format("true"), "limited as (select *, row_number() over (partition by request_id, source order by record_key) as nth from found)").replace("org_code = 'DG' and status = 'ACTIVE'", "org_code = 'XX' and status = 'INACTIVE'") + "select request_id, record_key from limited where nth <= 3")
def lookup_other_settings(spark, sf_dir):
    """Another organisation's inactive records, three of each source at most: all from the session's settings."""
    other = {"org_code": "XX", "status": "INACTIVE", "lookup_limit": "3"}
    for name, value in other.items():
        spark.conf.set(f"spark.weftwise.{name}", value)
    try:
        asked = _resolve_requests(spark, "name").filter("phone = '' and name != ''")
        return resolving.candidates(asked, derived.persons(spark, sf_dir)).select("request_id", "record_key")
    finally:
        for name in other:
            spark.conf.unset(f"spark.weftwise.{name}")


# ---------------------------------------------------------------- probes

_PREFIXES = [("mai", "sel"), ("k", "c"), ("", "wei"), ("jo", "mue"), ("ste", "l"), ("tom", "kar"), ("a", ""), ("joe", "mu"), ("pau", "zel"), ("xyz", "abc")]
_PREFIX_SQL = f"probes as (select unnest([{', '.join(repr(f) for f, _ in _PREFIXES)}]) as f, unnest([{', '.join(repr(x) for _, x in _PREFIXES)}]) as l)"
_STARTS = "(starts_with(lower({0}_name), {1}) or starts_with({2}a, {1}) or starts_with({2}b, {1}))"


# First letters with those that sound alike, spelt out letter by letter for the SQL alone.
_ALIKE = {
    "b": "bp", "p": "bp", "d": "dt", "t": "dt", "f": "fvw", "v": "fvw", "w": "fvw", "m": "mn", "n": "mn", "s": "csz", "z": "csz", "g": "cgkq", "k": "cgkq", "q": "cgkq", "c": "cgkqsz",
}


def _variants_sql(c: str) -> str:
    arms = " ".join(f"when '{k}' then [{', '.join(repr(x) for x in v)}]" for k, v in _ALIKE.items())
    return f"(case substr({c}, 1, 1) {arms} else [substr({c}, 1, 1)] end)"


def _probe_rows(spark: SparkSession, second: str = "last_prefix", rows=None) -> DataFrame:
    return spark.createDataFrame(rows or _PREFIXES, f"first_prefix string, {second} string")


@query(_person(_PREFIX_SQL) + f"select f as first_prefix, l as last_prefix, record_key from probes join person on {_STARTS.format('first', 'f', 'f')} and {_STARTS.format('last', 'l', 'l')} where source = 'directory'")
def lookup_prefix_directory(spark, sf_dir):
    return lookup.prefix_hits(_probe_rows(spark), derived.persons(spark, sf_dir).filter(F.col("source") == DIRECTORY))


@query(
    _person(_PREFIX_SQL, f"variants as (select f, l, unnest({_variants_sql('l')}) || substr(l, 2) as v from probes)")
    + f"select distinct f as first_prefix, l as last_prefix, record_key from variants join person on {_STARTS.format('first', 'f', 'f')} and {_STARTS.format('last', 'v', 'l')} where source = 'helpdesk'"
)
def lookup_prefix_helpdesk(spark, sf_dir):
    return lookup.prefix_hits(_probe_rows(spark), derived.persons(spark, sf_dir).filter(F.col("source") == HELPDESK))


_SUFFIXES = [("tho", "ellner"), ("m", "ell"), ("", "eyer"), ("kat", "uell"), ("ste", "ehmann"), ("pau", "arl")]
_RESTS = "(starts_with(substr(lower(last_name), 2), s) or starts_with(substr(la, 2), s) or starts_with(substr(lb, 2), s))"


@query(
    _person(f"probes as (select unnest([{', '.join(repr(f) for f, _ in _SUFFIXES)}]) as f, unnest([{', '.join(repr(x) for _, x in _SUFFIXES)}]) as s)")
    + f"select f as first_prefix, s as last_suffix, record_key from probes join person on {_STARTS.format('first', 'f', 'f')} and {_RESTS}"
)
def lookup_suffix(spark, sf_dir):
    return lookup.suffix_hits(_probe_rows(spark, "last_suffix", _SUFFIXES), derived.persons(spark, sf_dir)).select("first_prefix", "last_suffix", "record_key")


_PROBES = f"asked as ({derived.sql('probe', 'duckdb')}), probes as (select request_id, first_prefix, last_prefix, last_suffix, first_prefix as f, last_prefix as l, last_suffix as s from asked)"
_SHOWN = "record_key, source, domain, email"


def _index(spark: SparkSession, sf_dir: str, people: DataFrame) -> PersonIndex:
    """Each task writes a bucket, so there are more of them if there are many persons."""
    return PersonIndex.write(people, f"{shared_folder(people)}/weftwise-index-{uuid.uuid4().hex}", buckets=max(8, parts_of(people.count())), spread=2)


@query(
    _person(_PROBES, f"variants as (select request_id, f, l, unnest({_variants_sql('l')}) || substr(l, 2) as v from probes)")
    + f"select request_id, f as first_prefix, l as last_prefix, {_SHOWN} from probes join person on {_STARTS.format('first', 'f', 'f')} and {_STARTS.format('last', 'l', 'l')} where source = 'directory' "
    + f"union select request_id, f, l, {_SHOWN} from variants join person on {_STARTS.format('first', 'f', 'f')} and {_STARTS.format('last', 'v', 'l')} where source = 'helpdesk'"
)
def lookup_index_prefix(spark, sf_dir):
    """Each supplier's probe against the index on disk, with the records fetched from it."""
    people = settle(derived.persons(spark, sf_dir))
    index, asked = _index(spark, sf_dir, people), derived.table(spark, sf_dir, "probe").drop("last_suffix")
    return index.records_by_prefix(asked, ["record_key", "source", "domain", "email"])


@query(_person(_PROBES) + f"select request_id, f as first_prefix, s as last_suffix, {_SHOWN} from probes join person on {_STARTS.format('first', 'f', 'f')} and {_RESTS}")
def lookup_index_suffix(spark, sf_dir):
    people = settle(derived.persons(spark, sf_dir))
    index, asked = _index(spark, sf_dir, people), derived.table(spark, sf_dir, "probe").drop("last_prefix")
    return index.records_by_suffix(asked, ["record_key", "source", "domain", "email"])


def _alias_sql(groups, part: str) -> str:
    """Aliases worked out by SQL from the groups themselves, of the names that persons have."""
    return f"with all_person as ({derived.sql('person', 'duckdb')}) select name, prefix from ({_alias_pairs(groups)}) where name in (select lower({part}) from all_person)"


def _alias_pairs(groups) -> str:
    listed = ", ".join(f"({g}, '{x.lower()}')" for g, group in enumerate(groups) for x in group)
    return f"select distinct a.n as name, left(b.n, 3) as prefix from (values {listed}) a(g, n) join (values {listed}) b(g, n) on a.g = b.g and a.n <> b.n and left(a.n, 3) <> left(b.n, 3)"


def _alias_probes(spark: SparkSession, sf_dir: str, part: str, groups) -> DataFrame:
    names = derived.table(spark, sf_dir, "person").select(F.lower(part).alias("name")).distinct()
    return names.select("name", F.explode(aliases.alias_prefixes(F.col("name"), groups)).alias("prefix"))


@query(_alias_sql(aliases.FIRST_NAMES, "first_name"))
def alias_probe_first(spark, sf_dir):
    return _alias_probes(spark, sf_dir, "first_name", aliases.FIRST_NAMES)


@query(_alias_sql(aliases.LAST_NAMES, "last_name"))
def alias_probe_last(spark, sf_dir):
    return _alias_probes(spark, sf_dir, "last_name", aliases.LAST_NAMES)


# ---------------------------------------------------------------- links and clusters


def _in_one_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(derived.persons(spark, sf_dir).withColumn("request_id", F.lit(0)))


def _keys_sql(source: str) -> str:
    phones = "[office_phone, mobile_phone, other_phone]" if source == DIRECTORY else "[phone_no]"
    return f"keyed as (select record_key, unnest(list_filter(list_concat([case when email <> '' then 'email ' || lower(email) else '' end], list_transform({phones}, lambda x : case when x in ('', '0') then '' else 'phone ' || x end)), lambda x : x <> '')) as k from person where source = '{source}')"


def _link_pairs(spark: SparkSession, sf_dir: str, source: str) -> DataFrame:
    """Members and leaders of each key; the pairs of a key are never made."""
    rows = _in_one_request(spark, sf_dir).filter(F.col("source") == source)
    return cluster.key_leaders(rows, ["request_id"]).select("record_key", "k", "leader", "members")


_PAIRS = "select distinct record_key, k, min(record_key) over (partition by k) as leader, count(*) over (partition by k) as members from (select distinct record_key, k from keyed)"


@query(_person(_keys_sql(DIRECTORY)) + _PAIRS)
def link_pairs_directory(spark, sf_dir):
    return _link_pairs(spark, sf_dir, DIRECTORY)


@query(_person(_keys_sql(HELPDESK)) + _PAIRS)
def link_pairs_helpdesk(spark, sf_dir):
    return _link_pairs(spark, sf_dir, HELPDESK)


# the name key alone pairs too many at once in SQL, so there the three cases are joined one by one
_CROSS = """cross_pairs as (
  select distinct d.record_key as directory_key, h.record_key as helpdesk_key from (select * from person where source = 'directory') d join (select * from person where source = 'helpdesk') h on {1}(
    (d.email <> '' and h.email <> '' and lower(d.email) = lower(h.email)) or (h.phone_no <> '' and h.phone_no in (d.office_phone, d.mobile_phone, d.other_phone)) or (d.first_key = h.first_key and d.last_key = h.last_key)) and {0})"""


@query(
    _person(_CROSS.format(_SAME, "")) + "select directory_key as record_key, min(helpdesk_key) as other_key, count(*) as others from cross_pairs group by directory_key "
    "union all select helpdesk_key, min(directory_key), count(*) from cross_pairs group by helpdesk_key"
)
def link_pairs_cross(spark, sf_dir):
    """Each record's links across sources: how many, and the first."""
    return cluster.cross_links(_in_one_request(spark, sf_dir), ["request_id"]).select("record_key", "other_key", "others")


def _closure(links: str, nodes: str = "select record_key as node from person") -> str:
    """Labels of components; ``links`` selects (a, b)."""
    return f"link as (select a, b from ({links}) union select b, a from ({links})), reach(node, seen) as (select node, node from ({nodes}) union select reach.node, link.b from reach join link on reach.seen = link.a), labels as (select node, min(seen) as label from reach group by node)"


_KEY_LINKS = "select record_key as a, min(record_key) over (partition by k) as b from keyed"


@query(_person(_keys_sql(DIRECTORY), _closure(_KEY_LINKS, "select record_key as node from person where source = 'directory'")) + "select node as record_key, label as cluster from labels")
def clusters_directory(spark, sf_dir):
    rows = _in_one_request(spark, sf_dir).filter(F.col("source") == DIRECTORY)
    return cluster.clusters(rows, ["request_id"]).select("record_key", "cluster")


_BOTH_KEYS = _keys_sql(DIRECTORY).replace("keyed as", "keyed_d as") + ", " + _keys_sql(HELPDESK).replace("keyed as", "keyed_h as")
_MIXED_LINKS = "select record_key as a, min(record_key) over (partition by k) as b from keyed_d union all select record_key, min(record_key) over (partition by k) from keyed_h union all select directory_key, helpdesk_key from cross_pairs"


@query(_person(_BOTH_KEYS, _CROSS.format(_SAME, ""), _closure(_MIXED_LINKS)) + "select node as record_key, label as cluster from labels")
def clusters_mixed(spark, sf_dir):
    return cluster.clusters(_in_one_request(spark, sf_dir), ["request_id"], across=True).select("record_key", "cluster")


@query(
    _person(_BOTH_KEYS, _CROSS.format(_SAME, ""), _closure(_MIXED_LINKS))
    + f"select cluster, source, record_key, external_id from (select label as cluster, source, record_key, case when xid <> '' then xid else id end as external_id, {_BEST.format('label, source')} as nth from labels join person on node = record_key) where nth = 1"
)
def representatives(spark, sf_dir):
    grouped = cluster.clusters(_in_one_request(spark, sf_dir), ["request_id"], across=True)
    best = cluster.representatives(grouped, ["cluster"])
    return best.select("cluster", "source", "record_key", cluster.external_id(F.col("xid"), F.col("id")).alias("external_id"))


@query(_person(_keys_sql(DIRECTORY), _closure(_KEY_LINKS, "select record_key as node from person where source = 'directory'")) + "select n as size, count(*) as components from (select label, count(*) as n from labels group by label) group by n")
def component_sizes(spark, sf_dir):
    person = derived.persons(spark, sf_dir).filter(F.col("source") == DIRECTORY)
    keyed = person.select("record_key", F.explode(cluster.link_keys()).alias("k"))
    links = keyed.join(keyed.groupBy("k").agg(F.min("record_key").alias("first")), "k").select("record_key", "first")
    labels = components.connected_components(person.select(F.col("record_key").alias("node")), links)
    return labels.groupBy("label").count().groupBy(F.col("count").alias("size")).agg(F.count(F.lit(1)).alias("components"))


_STAYS = "(substr(id, 3)::int % 7 <> 3 or substr(id, 3)::int % 4 = 0 or substr(id, 3)::int % 14 = 3)"
_STAYING_KEYS = _keys_sql(DIRECTORY).replace("from person where", f"from person where {_STAYS} and")


@query(_person(_STAYING_KEYS, _closure(_KEY_LINKS, f"select record_key as node from person where source = 'directory' and {_STAYS}")) + "select node as record_key, label as cluster from labels")
def clusters_after_batches(spark, sf_dir):
    """Clusters kept over three batches: persons come, some go, some of those come back."""
    people = settle(derived.persons(spark, sf_dir).filter(F.col("source") == DIRECTORY).withColumn("k", F.substring("id", 3, 20).cast("int")))
    state = incremental.build(people.filter("k % 4 != 0"))
    state = incremental.update(state, people.filter("k % 4 = 0"), people.filter("k % 7 = 3").select("record_key"))
    state = incremental.update(state, people.filter("k % 14 = 3"), people.limit(0).select("record_key"))
    return incremental.records(state)


# ---------------------------------------------------------------- resolve


def _resolve_sql(requests: str, where: str = "true") -> str:
    node = "(request_id::varchar || ' ' || record_key)"
    linked = _LINKED.format("not a.by_phone")
    return _person(
        requests, _FOUND.format(where),
        f"pair_links as (select {node.replace('request_id', 'a.request_id').replace('record_key', 'a.record_key')} as a, {node.replace('request_id', 'b.request_id').replace('record_key', 'b.record_key')} as b from found a join found b on a.request_id = b.request_id and a.source = b.source and a.record_key < b.record_key and ({linked}))",
        _closure("select a, b from pair_links", f"select {node} as node from found"),
        "grouped as (select found.*, label from found join labels on node = " + node + ")",
        "counts as (select request_id, count(distinct label) filter (source = 'directory') as d, count(distinct label) filter (source = 'helpdesk') as h from grouped group by request_id)",
        f"confirmed as (select distinct d.request_id from (select * from found where source = 'directory') d join (select * from found where source = 'helpdesk') h on d.request_id = h.request_id and {_SAME})",
        f"best as (select *, {_BEST.format('request_id, source')} as nth, case when xid <> '' then xid else id end as ext from grouped)",
        "decided as (select r.request_id, case when (r.phone = '') = (r.name = '') then 'bad_request' when coalesce(d, 0) > 1 or coalesce(h, 0) > 1 then 'ambiguous' when coalesce(d, 0) = 1 and coalesce(h, 0) = 1 and c.request_id is null then 'ambiguous' when coalesce(d, 0) = 0 and coalesce(h, 0) = 0 then 'not_found' else 'ok' end as status from requests r left join counts n on n.request_id = r.request_id left join confirmed c on c.request_id = r.request_id)",
    ) + """select x.request_id, x.status, case when x.status = 'ok' then d.id end as directory_id, case when x.status = 'ok' then d.ext end as directory_xid, case when x.status = 'ok' then h.id end as helpdesk_id, case when x.status = 'ok' then h.ext end as helpdesk_xid,
  case when x.status = 'ok' then coalesce(trim(d.first_name || ' ' || d.last_name), trim(h.first_name || ' ' || h.last_name)) end as display_name, case when x.status = 'ok' then coalesce(nullif(d.email, ''), h.email, d.email) end as email
  from decided x left join best d on d.request_id = x.request_id and d.source = 'directory' and d.nth = 1 left join best h on h.request_id = x.request_id and h.source = 'helpdesk' and h.nth = 1"""  # fmt: skip


@query(_resolve_sql(_PHONES))
def resolve_by_phone(spark, sf_dir):
    return resolving.resolve(_resolve_requests(spark, "phone"), derived.persons(spark, sf_dir))


@query(_resolve_sql(_PHONES))
def resolve_stream(spark, sf_dir):
    """The same requests as a stream, answered batch by batch."""
    asked = _resolve_requests(spark, "phone")
    folder, people = f"{shared_folder(asked)}/weftwise-stream-{uuid.uuid4().hex}", settle(derived.persons(spark, sf_dir))
    asked.repartition(2).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    serve(stream, lambda rows: resolving.resolve(rows, people), f"{folder}/out", f"{folder}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("request_id", *resolving.IDENTITY)


@query(_resolve_sql(_NAMES))
def resolve_by_name(spark, sf_dir):
    return resolving.resolve(_resolve_requests(spark, "name"), derived.persons(spark, sf_dir))


@query(_resolve_sql(_NAMES, "p.domain = 'a.example.com'"))
def resolve_with_domain(spark, sf_dir):
    return resolving.resolve(_resolve_requests(spark, "name", "A.example.com"), derived.persons(spark, sf_dir))


# ---------------------------------------------------------------- match

_HEARD_FIRST = ["Mike", "Maik", "M", "Stefan", "Tomas", "Joerg", "Catrin", "Paula", "Ana", "Marek"]
_HEARD_LAST = ["Selner", "Fellner", "Mayer", "Müller", "Weiss Krueger", "L", "Kelner", "Carl", "Leman", "Zellner", "Meier"]
_HINTS = ["", "Sel", "", "Mü", "lan"]

_STT_ROWS = """select n_nationkey as request_id, {pick:HEARD_FIRST:n_nationkey % 10} as f, {pick:HEARD_LAST:n_nationkey % 11} as l, {pick:HINTS:n_nationkey % 5} as hint from nation"""


def _stt(dialect: str) -> str:
    lists = {"HEARD_FIRST": _HEARD_FIRST, "HEARD_LAST": _HEARD_LAST, "HINTS": _HINTS}
    derived.LISTS.update(lists)
    derived.TABLES["stt"] = _STT_ROWS
    return derived.sql("stt", dialect)


def _match_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy requests: raw always, the others for some; one has no text at all."""
    _stt("spark")
    rows = derived.table(spark, sf_dir, "stt")
    n = F.col("request_id")

    def part(c: str, tag: str) -> F.Column:
        said = F.when(n == 24, F.lit(" ")).otherwise(F.col(c))
        words = F.to_json(F.array(F.struct(said.alias("word"), F.lit(0.8).alias("confidence"))))
        return F.struct(
            said.alias("raw"), F.when(n % 2 == 0, F.concat(F.lit("\t"), F.lower(said), F.lit(" "))).otherwise("").alias("nlp"), F.when(n % 3 == 0, F.concat(F.lit(f"<{tag}>"), said, F.lit(f"</{tag}>"))).otherwise("<x></x>").alias("tagged"),
            F.when(n % 5 == 2, F.concat(F.lit(f"<a>\n<{tag} id='1'>"), said, F.lit(f"</{tag}></a>"))).alias("slotted"), F.when((n % 4 == 1) & (n != 24), words).when(n % 4 == 2, '[{"word":5}]').when(n % 4 == 3, '{"word":"x"}').otherwise("not json").alias("structured"),
        )

    domains = F.when(n % 6 == 5, F.array(F.lit("a.example.com"))).otherwise(F.array().cast("array<string>"))
    return rows.select(n.cast("long").alias("request_id"), part("f", "first").alias("first"), part("l", "last").alias("last"), domains.alias("domains"), F.col("hint").alias("last_name_hint"))


_REPS = f"""stt as ({_stt("duckdb")}),
heard as (select request_id, 'raw' as rep, f as first, l as last from stt union all select request_id, 'nlp', lower(f), lower(l) from stt where request_id % 2 = 0
  union all select request_id, 'tagged', f, l from stt where request_id % 3 = 0 union all select request_id, 'structured', f, l from stt where request_id % 4 = 1 union all select request_id, 'slotted', f, l from stt where request_id % 5 = 2),
reps as (select request_id::bigint as request_id, rep, first, last, (count(*) over (partition by request_id))::int as total, {_a("first")} as hfa, {_b("first")} as hfb, {_a("last")} as hla, {_b("last")} as hlb from heard where request_id <> 24)"""


@query(f"with {_REPS} select request_id, rep, first, last, total from reps")
def usable_representations(spark, sf_dir):
    return matching.representations(_match_requests(spark, sf_dir))


_RETRIEVED = f"""{_REPS},
first_alias as (select name as n, prefix as p from ({_alias_pairs(aliases.FIRST_NAMES)})), last_alias as (select name as n, prefix as p from ({_alias_pairs(aliases.LAST_NAMES)})),
probes as (select request_id, rep, left(hfa, 3) as f, left(hla, 3) as l from reps union select request_id, rep, left(hfb, 3), left(hlb, 3) from reps
  union select request_id, rep, p, left(hla, 3) from reps join first_alias on n = hfa union select request_id, rep, left(hfa, 3), p from reps join last_alias on n = hla),
variants as (select request_id, rep, f, l, unnest({_variants_sql('l')}) || substr(l, 2) as v from probes),
hits as (select request_id, rep, record_key from probes join person on {_STARTS.format('first', 'f', 'f')} and {_STARTS.format('last', 'l', 'l')} where source = 'directory'
  union select request_id, rep, record_key from variants join person on {_STARTS.format('first', 'f', 'f')} and {_STARTS.format('last', 'v', 'l')} where source = 'helpdesk'
  union select request_id, rep, record_key from (select request_id, rep, left(hfa, 3) as f, substr(hla, 2) as s from reps where length(hla) >= 4) join person on {_STARTS.format('first', 'f', 'f')} and {_RESTS}),
retrieved as (select h.request_id, h.rep, p.* from hits h join person p on p.record_key = h.record_key where h.request_id % 6 <> 5 or p.domain = 'a.example.com')"""


@query(_person(_RETRIEVED) + "select request_id, rep, record_key from retrieved")
def blocking_probe_union(spark, sf_dir):
    requests = _match_requests(spark, sf_dir)
    return matching.retrieved(requests, matching.representations(requests), derived.persons(spark, sf_dir)).select("request_id", "rep", "record_key")


_SCOPED = "(request_id::varchar || ' ' || rep || ' ' || {0})"
_GROUPS = f"""{_RETRIEVED},
scoped_keys as (select request_id, rep, source, record_key, unnest(list_filter(list_concat([case when email <> '' then 'email ' || lower(email) else '' end], list_transform(case when source = 'directory' then [office_phone, mobile_phone, other_phone] else [phone_no] end, lambda x : case when x in ('', '0') then '' else 'phone ' || x end)), lambda x : x <> '')) as k from retrieved),
key_links as (select {_SCOPED.format('record_key')} as a, min({_SCOPED.format('record_key')}) over (partition by request_id, rep, source, k) as b from scoped_keys),
pair_links as (select d.request_id::varchar || ' ' || d.rep || ' ' || d.record_key as a, h.request_id::varchar || ' ' || h.rep || ' ' || h.record_key as b from (select * from retrieved where source = 'directory') d join (select * from retrieved where source = 'helpdesk') h on d.request_id = h.request_id and d.rep = h.rep and {_SAME}),
{_closure("select a, b from key_links union all select a, b from pair_links", f"select {_SCOPED.format('record_key')} as node from retrieved")},
grouped as (select r.*, label from retrieved r join labels on node = {_SCOPED.format('r.record_key')}),
ranked as (select *, {_BEST.format('label, source')} as nth from grouped),
named as (select request_id, rep, label, arg_min(first_name, (source <> 'directory')::int) as first_name, arg_min(last_name, (source <> 'directory')::int) as last_name from ranked where nth = 1 group by request_id, rep, label),
keyed_names as (select n.*, {_a('n.first_name')} as fa, {_b('n.first_name')} as fb, {_a('n.last_name')} as la, {_b('n.last_name')} as lb, hfa, hfb, hla, hlb, hint, {_a('hint')} as hint_a, {_b('hint')} as hint_b from named n join reps r on r.request_id = n.request_id and r.rep = n.rep join stt s on s.request_id = n.request_id),
quality as (select *, least(1.0::double, greatest({_ratio('hfa', 'fa')}, {_ratio('hfa', 'fb')}, {_ratio('hfb', 'fa')}, {_ratio('hfb', 'fb')}) + case when hfb <> '' and fb <> '' and {_koelner('hfb')} = {_koelner('fb')} then 0.35::double else 0.0::double end) as fq,
  least(1.0::double, greatest({_ratio('hla', 'la')}, {_ratio('hla', 'lb')}, {_ratio('hlb', 'la')}, {_ratio('hlb', 'lb')}) + case when hlb <> '' and lb <> '' and {_koelner('hlb')} = {_koelner('lb')} then 0.35::double else 0.0::double end) as lq from keyed_names),
pointed as (select request_id, rep, label, case when hint_a <> '' and (starts_with(la, hint_a) or starts_with(lb, hint_b)) then least(50, sp + 10) else sp end as stage_points from (select *, cast(floor(50.0::double * (0.35::double * fq + 0.65::double * lq) + 0.5::double) as int) as sp from quality)),
scored as (select g.*, stage_points, min(g.record_key) over (partition by g.label) as cluster from grouped g join pointed p on p.label = g.label)"""


@query(_person(_GROUPS) + "select request_id, rep, record_key, cluster, stage_points from scored")
def match_stage_points(spark, sf_dir):
    requests = _match_requests(spark, sf_dir)
    return matching.scored_groups(requests, matching.representations(requests), settle(derived.persons(spark, sf_dir))).select("request_id", "rep", "record_key", "cluster", "stage_points")


_TOP = f"""{_GROUPS},
heads as (select request_id, rep, cluster, row_number() over (partition by request_id, rep order by stage_points desc, cluster) as nth from (select distinct request_id, rep, cluster, stage_points from scored)),
kept as (select s.* from scored s join heads h on h.request_id = s.request_id and h.rep = s.rep and h.cluster = s.cluster where h.nth <= 15)"""


@query(_person(_TOP) + "select request_id, rep, record_key, cluster, stage_points from kept")
def match_top15(spark, sf_dir):
    requests = _match_requests(spark, sf_dir)
    groups = matching.best_groups(requests, matching.representations(requests), settle(derived.persons(spark, sf_dir)))
    return groups.select("request_id", "rep", "record_key", "cluster", "stage_points")


def _bound(a: str, b: str) -> str:
    return f"(case when greatest(length({a}), length({b})) = 0 then 0.0::double else 1.0::double - abs(length({a}) - length({b}))::double / greatest(length({a}), length({b})) end)"


def _quality_bound(h: str, s: str) -> str:
    ratios = ", ".join(_bound(f"{h}{x}", f"{s}{y}") for x in "ab" for y in "ab")
    return f"least(1.0::double, greatest({ratios}) + case when {h}b <> '' and {s}b <> '' and {_koelner(h + 'b')} = {_koelner(s + 'b')} then 0.35::double else 0.0::double end)"


@query(
    _person(_GROUPS)
    + f""", bounds as (select request_id, rep, label, cast(floor(50.0::double * (0.35::double * {_quality_bound('hf', 'f')} + 0.65::double * {_quality_bound('hl', 'l')}) + 0.5::double) as int) as b, hint_a <> '' and (starts_with(la, hint_a) or starts_with(lb, hint_b)) as hinted from keyed_names),
capped as (select distinct b.request_id, b.rep, s.cluster, s.stage_points, case when hinted then least(50, b + 10) else b end as most_points from bounds b join scored s on s.label = b.label),
likely as (select *, row_number() over (partition by request_id, rep order by most_points desc, cluster) as nth, count(*) over (partition by request_id, rep) as groups from capped),
reached as (select *, case when groups >= 15 then min(stage_points) filter (nth <= 15) over (partition by request_id, rep) end as least from likely)
select request_id, rep, any_value(groups) as groups, count(*) filter (nth <= 15 or (least is not null and most_points >= least)) as scored from reached group by request_id, rep"""
)
def match_scored_counts(spark, sf_dir):
    """How many groups a rendering has, and how many have their edit distances worked out."""
    requests = _match_requests(spark, sf_dir)
    _, heard = matching.heard_groups(requests, matching.representations(requests), settle(derived.persons(spark, sf_dir)))
    return matching.scoring_report(heard)


_FINAL = f"""{_TOP},
member as (select distinct {_SCOPED.format('cluster')} as g, request_id::varchar || ' r ' || record_key as r from kept),
joined(g, seen) as (select distinct g, g from member union select joined.g, b.g from joined join member a on a.g = joined.seen join member b on b.r = a.r),
finals as (select g, min(seen) as final from joined group by g),
merged as (select k.*, final from kept k join finals on g = {_SCOPED.format('k.cluster')}),
summed as (select request_id, final, max(stage_points) as stage_points, count(distinct rep)::int as hits, min(record_key) as first_record from merged group by request_id, final),
rivals as (select *, sum((2 * stage_points >= top)::int) over (partition by request_id) as n from (select *, max(stage_points) over (partition by request_id) as top from summed)),
people as (select *, case when xid <> '' then xid else id end as ext, {_BEST.format('request_id, final, source')} as nth from (select distinct request_id, final, record_key, id, xid, source, first_name, last_name, email, office_phone, mobile_phone, other_phone, phone_no from merged)),
shown as (select v.*, t.total, coalesce(d.ext, '') as directory_xid, coalesce(h.ext, '') as helpdesk_xid, case when coalesce(d.first_name, '') <> '' then d.first_name else coalesce(h.first_name, '') end as first_name,
  case when coalesce(d.first_name, '') <> '' or h.last_name is null then coalesce(d.last_name, '') else h.last_name end as last_name
  from rivals v join (select distinct request_id, total from reps) t on t.request_id = v.request_id left join people d on d.request_id = v.request_id and d.final = v.final and d.source = 'directory' and d.nth = 1 left join people h on h.request_id = v.request_id and h.final = v.final and h.source = 'helpdesk' and h.nth = 1),
points as (select *, case when hits >= total then 30 when 4 * hits >= 3 * total then 20 when 2 * hits >= total then 10 else 0 end as representation_points, case n when 1 then 20 when 2 then 10 else 0 end as uniqueness_points, {_b('first_name')} as nfb, {_b('last_name')} as nlb from shown),
ordered as (select *, stage_points + representation_points + uniqueness_points as confidence, row_number() over (partition by request_id order by stage_points + representation_points + uniqueness_points desc, first_record) as nth from points)"""


@query(
    _person(_FINAL)
    + f"select request_id, nth::int as nth, trim(first_name || ' ' || last_name) as name, first_name, last_name, {_koelner('nfb')} as first_phonetic, {_koelner('nlb')} as last_phonetic, directory_xid, helpdesk_xid, stage_points, representation_points, uniqueness_points, confidence from ordered where nth <= 5"
)
def match_candidates(spark, sf_dir):
    return matching.candidates(_match_requests(spark, sf_dir), settle(derived.persons(spark, sf_dir)))


@query(ORACLE["match_candidates"])
def match_candidates_index(spark, sf_dir):
    """The same from the index on disk."""
    people = settle(derived.persons(spark, sf_dir))
    return matching.candidates(_match_requests(spark, sf_dir), people, _index(spark, sf_dir, people))


@query("select n_nationkey::bigint as request_id, case when n_nationkey = 24 then 'bad_request' else 'ok' end as status from nation")
def match_status(spark, sf_dir):
    return matching.match_status(_match_requests(spark, sf_dir))


# ---------------------------------------------------------------- graph

_GRAPH = f"""with edge as ({derived.sql("edge", "duckdb")}), ticket as ({derived.sql("ticket", "duckdb")}),
links as (select in_id as person_id, out_id as ticket_node from edge where verb in ('affects', 'assignedTo') union select out_id, in_id from edge where verb = 'opens'),
view as (select id, xid, ext_id, ticket_id, subject, case when clean_description <> '' then clean_description else description end as description, status, priority, created_at from ticket)"""


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return derived.table(spark, sf_dir, "edge"), derived.table(spark, sf_dir, "ticket")


@query(_GRAPH + "select person_id, ticket_node, v.xid, subject, description, status, priority, created_at from links join view v on v.id = ticket_node")
def person_tickets(spark, sf_dir):
    """The tickets of every person of an edge."""
    edges, tickets = _graph(spark, sf_dir)
    asked = edges.select(F.explode(F.array("in_id", "out_id")).alias("person_id")).filter("person_id like 'c-%'")
    return graph.person_tickets(asked, edges, tickets).select("person_id", "ticket_node", "xid", "subject", "description", "status", "priority", "created_at")


_TICKET_KEYS = "requests as (select i as request_id, case i % 3 when 0 then 'E' || i::varchar when 1 then 'T' || i::varchar else 't-' || i::varchar end as key, 'c-' || (i % 50)::varchar as person_id from range(400) r(i))"
_ANY_ID = """listed as (select id, ext_id as key, 1 as prio from ticket union all select id, ticket_id, 2 from ticket union all select id, id, 3 from ticket),
found as (select request_id, person_id, key, id from (select r.*, l.id, row_number() over (partition by request_id order by prio, l.id) as nth from requests r join listed l on l.key = r.key) where nth = 1)"""


def _ticket_requests(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    key = F.concat(F.when(i % 3 == 0, "E").when(i % 3 == 1, "T").otherwise("t-"), i.cast("string"))
    return spark.range(400).select(i.alias("request_id"), key.alias("key"), F.concat(F.lit("c-"), (i % 50).cast("string")).alias("person_id"))


@query(f"{_GRAPH}, {_TICKET_KEYS}, {_ANY_ID} select request_id, key, id from found")
def ticket_by_any_id(spark, sf_dir):
    return graph.ticket_by_any_id(_ticket_requests(spark), _graph(spark, sf_dir)[1]).select("request_id", "key", "id")


@query(
    f"{_GRAPH}, owner as (select min(person_id) as person_id, ticket_node from links where ticket_node in (select id from ticket) group by ticket_node), requests as (select (row_number() over (order by ticket_node))::bigint as request_id, ticket_node as key, case when ticket_node like '%7' then 'c-none' else person_id end as person_id from owner), {_ANY_ID} "
    "select f.key, f.id, f.person_id from found f where exists (select 1 from links l where l.person_id = f.person_id and l.ticket_node = f.id)"
)
def owned_ticket(spark, sf_dir):
    edges, tickets = _graph(spark, sf_dir)
    owner = graph.ticket_links(edges).groupBy("ticket_node").agg(F.min("person_id").alias("person_id"))
    asked = owner.select(F.xxhash64("ticket_node").alias("request_id"), F.col("ticket_node").alias("key"), F.when(F.col("ticket_node").endswith("7"), "c-none").otherwise(F.col("person_id")).alias("person_id"))
    return graph.owned_tickets(asked, edges, tickets).select("key", "id", "person_id")


@query(f"{_GRAPH} select person_id, ticket_node from links where ticket_node not in (select id from ticket)")
def dangling_edges(spark, sf_dir):
    return graph.dangling_edges(*_graph(spark, sf_dir)).select("person_id", "ticket_node")


@query(
    f"with account as ({derived.sql('account', 'duckdb')}), edge as ({derived.sql('connects', 'duckdb')}), found as (select in_id, a.id, a.xid, a.status, row_number() over (partition by in_id order by a.id) as nth from edge join account a on a.id = out_id where a.source = 'directory') "
    "select 'c-' || c_custkey as person_id, f.id as account_id, case when f.xid <> '' then f.xid else f.id end as account_xid, f.status as account_status from customer left join found f on f.in_id = 'c-' || c_custkey and nth = 1"
)
def person_account(spark, sf_dir):
    people = derived.table(spark, sf_dir, "person").filter(F.col("source") == DIRECTORY).select(F.col("id").alias("person_id"))
    return graph.person_account(people, derived.table(spark, sf_dir, "connects"), derived.table(spark, sf_dir, "account"))


_BROKEN = {13: '{"xid": "x", "source": ["list"], "status": {"a": 1}}', 17: "no json", 19: '{"xid": "y", "source": "directory", "status": null}'}


def _stored_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accounts, tickets and intents in one table; some accounts are no objects or have fields of other types."""
    accounts = derived.table(spark, sf_dir, "account")
    k, json = F.substring("id", 3, 20).cast("int"), F.to_json(F.struct("xid", "source", "status"))
    for n, text_ in _BROKEN.items():
        json = F.when(k % n == 0, text_).otherwise(json)
    return settle(node_table.union([node_table.as_nodes(accounts, "account", json=json), *[node_table.as_nodes(derived.table(spark, sf_dir, t), t) for t in ("ticket", "intent")]]))


def _sound(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return node_table.typed(_stored_nodes(spark, sf_dir), "account", ACCOUNT, ("source", "status"))


@query(
    f"with account as (select * from ({derived.sql('account', 'duckdb')}) where {' and '.join(f'substr(id, 3)::int % {n} <> 0' for n in _BROKEN)}), edge as ({derived.sql('connects', 'duckdb')}), found as (select in_id, a.id, a.xid, a.status, row_number() over (partition by in_id order by a.id) as nth from edge join account a on a.id = out_id where a.source = 'directory') "
    "select 'c-' || c_custkey as person_id, f.id as account_id, case when f.xid <> '' then f.xid else f.id end as account_xid, f.status as account_status from customer left join found f on f.in_id = 'c-' || c_custkey and nth = 1"
)
def person_account_nodes(spark, sf_dir):
    """Accounts from the table of all nodes, edges from a table that is read with its schema."""
    people = derived.table(spark, sf_dir, "person").filter(F.col("source") == DIRECTORY).select(F.col("id").alias("person_id"))
    good, _ = _sound(spark, sf_dir)
    folder = f"{shared_folder(people)}/weftwise-edges-{uuid.uuid4().hex}"
    derived.table(spark, sf_dir, "connects").write.format("orc").save(folder)
    return graph.person_account(people, read(spark, folder, "orc", EDGE), good)


@query(
    f"select id, 'account' as type, case when k % 19 = 0 then 'status is missing' when k % 17 = 0 then 'no object' else 'source is no string; status is no string' end as reason from (select id, substr(id, 3)::int as k from ({derived.sql('account', 'duckdb')})) where k % 13 = 0 or k % 17 = 0 or k % 19 = 0"
)
def node_rejects(spark, sf_dir):
    """The accounts that don't fit, with why."""
    return _sound(spark, sf_dir)[1]


@query(f"select id, subject, description, created_at::date as created_at from ({derived.sql('ticket', 'duckdb')})")
def node_tickets(spark, sf_dir):
    """Tickets from the table of all nodes, with a field as a date."""
    return node_table.typed(_stored_nodes(spark, sf_dir), "ticket", "subject string, description string, created_at date", ("subject",))[0]


_PATHS = f"""{_GRAPH.replace("with edge as (", "with edge as (" + derived.sql("connects", "duckdb") + " union all ")},
account as ({derived.sql("account", "duckdb")}),
to_person as (select out_id as ticket_node, in_id as person_id from edge where verb in ('affects', 'assignedTo') union select in_id, out_id from edge where verb = 'opens'),
starts as (select 'c-' || c_custkey as request_id from customer where c_custkey % 10 = 3)"""


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, type) of all that edges connect."""
    kinds = {"ticket": F.lit("ticket"), "person": F.lit("person"), "account": F.concat(F.lit("account "), F.col("source"))}
    tables = [derived.table(spark, sf_dir, name).select("id", kind.alias("type")) for name, kind in kinds.items()]
    return tables[0].union(tables[1]).union(tables[2])


@query(
    _PATHS + "select distinct s.request_id, a.id as node from starts s join links l on l.person_id = s.request_id join ticket t on t.id = l.ticket_node join to_person p on p.ticket_node = t.id "
    "join (select 'c-' || c_custkey as id from customer) c on c.id = p.person_id join edge e on e.verb = 'connects' and e.in_id = c.id join account a on a.id = e.out_id and a.source = 'directory'"
)
def traverse_three_steps(spark, sf_dir):
    """From persons over their tickets and the persons of these to directory accounts."""
    edges = derived.table(spark, sf_dir, "edge").union(derived.table(spark, sf_dir, "connects"))
    starts = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 10 = 3").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("request_id"))
    steps = [replace(graph.TO_TICKETS, node_type="ticket"), replace(graph.TO_PERSONS, node_type="person"), replace(graph.TO_ACCOUNTS, node_type="account directory")]
    return traverse.traverse(starts.withColumn("node", F.col("request_id")), edges, steps, _nodes(spark, sf_dir))


@query(_PATHS + "select distinct s.request_id, l.ticket_node as node from starts s join links l on l.person_id = s.request_id")
def traverse_one_step(spark, sf_dir):
    """From persons to whatever their ticket edges lead to, tickets that are missing included."""
    edges = derived.table(spark, sf_dir, "edge").union(derived.table(spark, sf_dir, "connects"))
    starts = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 10 = 3").select(F.concat(F.lit("c-"), F.col("c_custkey").cast("string")).alias("request_id"))
    return traverse.traverse(starts.withColumn("node", F.col("request_id")), edges, [graph.TO_TICKETS])


# ---------------------------------------------------------------- intents and issues


def _intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = derived.table(spark, sf_dir, "intent")
    keys = {attributes.TYPE: "intent_type", "ogit/description": "description", attributes.NAMES: "variable_names", attributes.VALUES: "variable_values"}
    return rows.select("id", F.create_map(*[x for k, c in keys.items() for x in (F.lit(k), F.col(c))]).alias("attrs"))


_INTENT = f"with intent as ({derived.sql('intent', 'duckdb')})"


@query(f"{_INTENT} select id, intent_type, description from intent where intent_type in (select p_type from part where p_partkey in (0, 1))")
def intents_by_type(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey in (0, 1)")
    types = [r[0] for r in part.select("p_type").distinct().collect()]  # the request's list
    rows = _intents(spark, sf_dir)
    return attributes.intents_by_type(rows.union(rows), types).select("id", F.element_at("attrs", attributes.TYPE).alias("intent_type"), F.element_at("attrs", "ogit/description").alias("description"))


@query(f"{_INTENT} select id, intent_type, description from intent")
def intents_all(spark, sf_dir):
    return attributes.intents_by_type(_intents(spark, sf_dir)).select("id", F.element_at("attrs", attributes.TYPE).alias("intent_type"), F.element_at("attrs", "ogit/description").alias("description"))


_VARIABLES = """lists as (select id, list_filter(list_transform(string_split(variable_names, ','), lambda x : trim(x)), lambda x : x <> '') as n, list_transform(string_split(variable_values, ','), lambda x : trim(x)) as v from intent),
spread as (select id, unnest(n) as name, unnest(range(1, len(n) + 1)) as i, v from lists), variables as (select id, name, arg_max(coalesce(v[i], ''), i) as value from spread group by id, name)"""


@query(f"{_INTENT}, {_VARIABLES} select id, name, value from variables")
def system_variables(spark, sf_dir):
    return _intents(spark, sf_dir).select("id", F.explode(attributes.system_variables(F.col("attrs"))).alias("name", "value"))


def _intent_requests(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """All events, each with an intent's id; with ``times`` 2, half of them ask for intents that don't exist."""
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.count(F.lit(1))).scalar()
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("parts", parts)
    return events.withColumn("id", F.concat(F.lit("i-"), (F.col("event_id") % (F.col("parts") * times)).cast("string")))


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues from all events over all intents: each uses an intent's variables and brings its own."""
    events = _intent_requests(spark, sf_dir).select("event_id", "event_type", "user_id", "id")
    # an intent's variables are worked out once, not for every issue of it
    intents = _intents(spark, sf_dir).select("id", attributes.system_variables(F.col("attrs")).alias("system"))
    user = F.map_from_arrays(F.array(F.lit("/v3"), F.lit("/subject"), F.lit("user")), F.array("event_type", F.when(F.col("event_id") % 4 == 0, F.concat(F.lit(" s"), F.col("event_id").cast("string"))).otherwise(" "), F.col("user_id").cast("string")))
    return attributes.issue_attributes(events.join(intents, "id").select(
        "event_id", "system", user.alias("user"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("arg"), F.col("event_id").cast("string"))).alias("subject"),
        F.lit("node-1").alias("origin"), F.when(F.col("event_id") % 2 == 0, "scope-a").alias("scope"),
    ))


_ISSUES = f"""{_INTENT}, {_VARIABLES},
ev as (select event_id, event_type, user_id, 'i-' || (event_id % (select count(*) from part))::varchar as id from events where 'i-' || (event_id % (select count(*) from part))::varchar in (select id from intent)),
parts as (select event_id, 1 as prio, name as key, value from ev join variables using (id)
  union all select event_id, 2, '/v3', event_type from ev union all select event_id, 2, '/subject', case when event_id % 4 = 0 then ' s' || event_id else ' ' end from ev union all select event_id, 2, 'user', user_id::varchar from ev
  union all select event_id, 3, 'ogit/subject', case when event_id % 3 = 0 then 'arg' || event_id when event_id % 4 = 0 then 's' || event_id else 'New issue' end from ev
  union all select event_id, 3, 'ogit/Automation/originNode', 'node-1' from ev union all select event_id, 3, 'ogit/scope', 'scope-a' from ev where event_id % 2 = 0),
attrs as (select event_id, key, arg_max(value, prio) as value from parts group by event_id, key)"""


@query(f"{_ISSUES} select event_id, key, value from attrs")
def issue_attributes(spark, sf_dir):
    return _issues(spark, sf_dir).select("event_id", F.explode("attrs").alias("key", "value"))


_PAYLOAD = """whole as (select event_id, key, value from attrs union all select event_id, 'ogit/_type', 'ogit/Automation/AutomationIssue' from ev)
select event_id, '{' || string_agg('"' || key || '":"' || value || '"', ',' order by key) || '}' as payload from whole group by event_id"""


def _payload() -> Column:
    return attributes.payload("ogit/Automation/AutomationIssue", F.create_map().cast("map<string,string>"), F.col("attrs")).alias("payload")


@query(f"{_ISSUES}, {_PAYLOAD}")
def issue_payload_json(spark, sf_dir):
    return _issues(spark, sf_dir).select("event_id", _payload())


@query(
    f"{_INTENT} select event_id, e.id, case when i.id is null then 'not_found' else 'ok' end as status, description "
    "from (select event_id, 'i-' || (event_id % (2 * (select count(*) from part)))::varchar as id from events) e left join intent i on i.id = e.id"
)
def intent_by_id(spark, sf_dir):
    found = attributes.by_id(_intent_requests(spark, sf_dir, 2).select("event_id", "id"), _intents(spark, sf_dir))
    return found.select("event_id", "id", "status", F.element_at("attrs", "ogit/description").alias("description"))


@query(
    f"{_ISSUES}, whole as (select event_id, key, value from attrs union all select event_id, 'ogit/_type', 'ogit/Automation/AutomationIssue' from ev) "
    "select e.event_id, case when w.event_id is null then 'not_found' else 'ok' end as status, w.key, w.value from events e left join (select * from whole where event_id % 10 <> 9) w on w.event_id = e.event_id"
)
def issue_variables(spark, sf_dir):
    """All variables of each event's issue, from the JSON that was stored; some issues are deleted."""
    number = F.col("event_id").cast("string")
    stored = _issues(spark, sf_dir).select(number.alias("id"), _payload(), (F.col("event_id") % 10 == 9).alias("is_deleted"))
    asked = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", number.alias("id"))
    return attributes.issue_variables(asked, stored).select("event_id", "status", F.explode_outer("variables").alias("key", "value"))


@query(
    f"{_INTENT}, asked as (select r_regionkey::bigint as request_id, p_type as t from region join part on p_partkey in (r_regionkey, r_regionkey + 7) where r_regionkey < 4) "
    "select distinct a.request_id, i.id from asked a join intent i on i.intent_type = a.t union all select 4, id from intent"
)
def intents_by_type_lists(spark, sf_dir):
    """Requests with their types as one text; the last names none."""
    part, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "region"))
    key = F.col("r_regionkey").cast("long").alias("request_id")
    named = region.filter("r_regionkey < 4").select(key, F.explode(F.array("r_regionkey", F.col("r_regionkey") + 7)).alias("p_partkey")).join(part, "p_partkey")
    lists = named.groupBy("request_id").agg(F.concat(F.lit(" , "), F.array_join(F.collect_list("p_type"), " ,,")).alias("types"))
    lists = lists.union(region.filter("r_regionkey >= 4").select(key, F.lit(" , ,").alias("types")))
    rows = _intents(spark, sf_dir)
    return attributes.intents_for(lists, rows.union(rows)).select("request_id", "id")


_STORED = _PAYLOAD.replace("\nselect event_id, '{'", ", made as (select '{'") + ")"


@query(f"{_ISSUES}, {_STORED} select distinct sha256(payload) as id, payload from made")
def issues_written_and_read(spark, sf_dir):
    """Issues of two overlapping writes and a rerun, read back: each once."""
    issues = settle(_issues(spark, sf_dir))
    store = nodes.NodeStore(spark, f"{shared_folder(issues)}/weftwise-nodes-{uuid.uuid4().hex}")
    for part in (issues.filter("event_id % 3 != 1"), issues.filter("event_id % 3 != 0"), issues.filter("event_id % 3 != 1")):
        store.write(part, "ogit/Automation/AutomationIssue")
    return store.read()


_STATUSES = {"view": "UNPROCESSED", "click": "PROCESSING", "signup": "WAITING", "purchase": "RESOLVED", "error": "STOPPED"}


@query(
    f"""with said as (select user_id::varchar || '/' || ((date_part('day', ts)::int - 1) // 5)::varchar as issue_id, case event_type {" ".join(f"when '{k}' then '{v}'" for k, v in _STATUSES.items())} end as status, epoch_us(ts) // 1000 as ms from events),
placed as (select *, row_number() over w as n, ms - lag(ms) over w > 43200000 as late from said window w as (partition by issue_id order by ms, status)),
ends as (select issue_id, min(n) filter (status in ('RESOLVED', 'STOPPED')) as t, min(n) filter (late) as g, max(n) as m, max(ms) as last from placed group by issue_id),
cut as (select issue_id, case when t is not null and (g is null or t < g) then t when g is not null then g - 1 else m end as n, t is not null and (g is null or t < g) as ended from ends
  where t is not null or g is not null or last + 43200000 <= (select max(ms) from said) - 600000)
select p.issue_id, p.status, case when ended then 'ended' else 'timed out' end as outcome, p.n as seen, epoch_ms((select min(ms) from placed q where q.issue_id = p.issue_id)) as first_at, epoch_ms(p.ms) as last_at from placed p join cut c on c.issue_id = p.issue_id and c.n = p.n"""
)
def issues_followed(spark, sf_dir):
    """The statuses of issues (a user's in five days) as a stream, until each is over or nothing is heard for half a day."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    period = F.floor((F.dayofmonth("ts") - 1) / 5)
    names = F.create_map(*[F.lit(x) for pair in _STATUSES.items() for x in pair])
    said = events.select(F.concat_ws("/", F.col("user_id").cast("string"), period.cast("string")).alias("issue_id"), F.element_at(names, F.col("event_type")).alias("status"), F.col("ts").cast("timestamp").alias("at"))
    folder = f"{shared_folder(events)}/weftwise-issues-{uuid.uuid4().hex}"
    for first in (1, 11, 21):  # files in the order of time
        said.filter(F.dayofmonth("at").between(first, first + (9 if first < 21 else 10))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(said.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    with polling.state_store(spark):
        polling.follow_issues(stream, "12 hours", "10 minutes").writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    return spark.read.schema(polling.ENDED).parquet(f"{folder}/out")


# ---------------------------------------------------------------- whole answers


@query(
    f"select x.*, f.account_xid, f.account_status from ({_resolve_sql(_PHONES)}) x left join (select person_id, account_xid, account_status from ("
    f"with account as ({derived.sql('account', 'duckdb')}), edge as ({derived.sql('connects', 'duckdb')}) select in_id as person_id, case when a.xid <> '' then a.xid else a.id end as account_xid, a.status as account_status, row_number() over (partition by in_id order by a.id) as nth "
    "from edge join account a on a.id = out_id where a.source = 'directory') where nth = 1) f on f.person_id = x.directory_id"
)
def auth_response(spark, sf_dir):
    found = resolving.resolve(_resolve_requests(spark, "phone"), derived.persons(spark, sf_dir))
    return resolving.with_account(found, derived.table(spark, sf_dir, "connects"), derived.table(spark, sf_dir, "account"))


@query(
    _person(_FINAL)
    + """, listed as (select request_id, to_json(list(struct_pack(nth := nth::int, name := trim(first_name || ' ' || last_name), first_name := first_name, last_name := last_name, directory_xid := directory_xid, helpdesk_xid := helpdesk_xid, confidence := confidence::int) order by nth))::varchar as body from ordered where nth <= 5 group by request_id)
select n_nationkey::bigint as request_id, case when n_nationkey = 24 then 'bad_request' else 'ok' end as status, case when n_nationkey <> 24 then coalesce(body, '[]') end as body from nation left join listed on request_id = n_nationkey"""
)
def match_responses(spark, sf_dir):
    """Requests as JSON bodies with fields that are dropped, and answers as JSON."""
    extra = lambda part: F.struct(f"{part}.*", F.lit("de").alias("language"), F.lit(0.7).alias("confidence"))
    sent = _match_requests(spark, sf_dir).withColumns({"first": extra("first"), "last": extra("last"), "channel": F.lit("phone")})
    requests = matching.requests_of(sent.select(F.to_json(F.struct("*")).alias("body")))
    return matching.responses(requests, matching.candidates(requests, derived.persons(spark, sf_dir)))


@query(
    _person(_NAMES, _FOUND.format("true"), "limited as (select *, row_number() over (partition by request_id, source order by record_key) as nth from found)")
    + "select request_id, record_key from limited where nth <= 2 and domain = 'a.example.com'"
)
def lookup_limit(spark, sf_dir):
    """The first two of each source, before the domain filter."""
    asked = _resolve_requests(spark, "name", "a.example.com").filter("phone = '' and name != ''")
    return resolving.candidates(asked, derived.persons(spark, sf_dir), lookup_limit=2).select("request_id", "record_key")


@query(
    f"select word, norm_a, norm_b, {_koelner('norm_b')} as code, domain from (select word, {_a('word')} as norm_a, {_b('word')} as norm_b, case when instr(word, '@') > 0 then lower(regexp_replace(word, '^.*@', '')) else '' end as domain from ({_WORDS}))"
)
def sql_functions_words(spark, sf_dir):
    """The registered functions, called from SQL text."""
    registry.register(spark)
    _words(spark, sf_dir).createOrReplaceTempView("weftwise_words")
    return spark.sql("select word, normalize_a(word) as norm_a, normalize_b(word) as norm_b, sound_code(normalize_b(word)) as code, email_domain(word) as domain from weftwise_words")

"""Match heard names: several renderings of a first and a last name to scored candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftwise.functions import similarity as S
from weftwise.functions.aliases import FIRST_NAMES, LAST_NAMES, alias_prefixes
from weftwise.functions.phonetic import koelner
from weftwise.functions.text import blank, normalize_a, normalize_b, short_prefix, strip_tags, structured_words, utrim
from weftwise.operators.cluster import clusters, external_id, representatives
from weftwise.operators.components import FOLDED, connected_components, folded_labels, split_by_size
from weftwise.operators.lookup import domain_filter, first_hits, prefix_hits, suffix_hits
from weftwise.operators.work import settle
from weftwise.sources.index import PersonIndex
from weftwise.sources.model import DIRECTORY, HELPDESK, MATCH_REQUEST

KEPT_PER_REP, KEPT = 15, 5
REPS = ("raw", "nlp", "tagged", "slotted", "structured")


def _heard(part: str, rep: str):
    c = F.col(part)[rep]
    return utrim(c) if rep in ("raw", "nlp") else strip_tags(c) if rep in ("tagged", "slotted") else blank(structured_words(c))


def representations(requests: DataFrame) -> DataFrame:
    """(request_id, rep, first, last, total): renderings in which both parts have text, and how many a request has."""
    listed = requests.select("request_id", F.inline(F.array(*[F.struct(F.lit(r).alias("rep"), _heard("first", r).alias("first"), _heard("last", r).alias("last")) for r in REPS])))
    usable = listed.filter("first != '' and last != ''")
    return usable.withColumn("total", F.count(F.lit(1)).over(Window.partitionBy("request_id")).cast("int"))


def probes(reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix probes and suffix probes of each rendering.

    Prefixes of both spellings, and of either part's aliases with the other part's own prefix; for last names of
    four letters and more also what follows the first letter.
    """
    r = reps.select(
        "request_id", "rep", normalize_a(F.col("first")).alias("fa"), normalize_b(F.col("first")).alias("fb"), normalize_a(F.col("last")).alias("la"), normalize_b(F.col("last")).alias("lb")
    )
    pair = lambda f, l: F.struct(f.alias("first_prefix"), l.alias("last_prefix"))  # noqa: E731, E741
    fa, fb, la, lb = (short_prefix(F.col(c)) for c in ("fa", "fb", "la", "lb"))
    every = F.concat(
        F.array(pair(fa, la), pair(fb, lb)), F.transform(alias_prefixes(F.col("fa"), FIRST_NAMES), lambda p: pair(p, la)), F.transform(alias_prefixes(F.col("la"), LAST_NAMES), lambda p: pair(fa, p))
    )
    prefix = r.select("request_id", "rep", F.inline(F.array_distinct(every)))
    suffix = r.filter(F.length("la") >= 4).select("request_id", "rep", fa.alias("first_prefix"), F.substr("la", F.lit(2)).alias("last_suffix"))
    return prefix, suffix


def retrieved(requests: DataFrame, reps: DataFrame, person: DataFrame, lookup_limit: int | None = None, index: PersonIndex | None = None) -> DataFrame:
    """Persons found by any probe, once for each request and rendering, of the request's domains.

    With ``lookup_limit`` only so many a request, rendering and source are looked at, before the domain filter. With
    an ``index`` of the persons they are neither scanned nor shuffled, and domains are looked at before they are fetched.
    """
    prefix, suffix = probes(reps)
    if index is not None:
        own = ["request_id", "rep", "record_key", "source", "domain"]
        hits = index.prefix_hits(prefix, person).select(*own).union(index.suffix_hits(suffix, person).select(*own)).distinct()
        return index.fetched(domain_filter(first_hits(hits, ["request_id", "rep", "source"], lookup_limit), requests))
    hits = prefix_hits(prefix, person).select("request_id", "rep", "record_key").union(suffix_hits(suffix, person).select("request_id", "rep", "record_key")).distinct()
    return domain_filter(first_hits(hits.join(person, "record_key"), ["request_id", "rep", "source"], lookup_limit), requests)


def different(reps: DataFrame) -> DataFrame:
    """``reps`` without renderings that are spelt like another of their request, with ``same``, all that are spelt so.

    Probes and points look at the normalised spellings alone, so such renderings find the same records, groups and points.
    """
    spelt = [n(F.col(c)).alias(f"__{c}{n.__name__[-1]}") for c in ("first", "last") for n in (normalize_a, normalize_b)]
    least = F.min(F.struct("rep", "first", "last", "total"))
    alike = reps.select("*", *spelt).groupBy("request_id", "__firsta", "__firstb", "__lasta", "__lastb").agg(least.alias("x"), F.collect_list("rep").alias("same"))
    return alike.select("request_id", "x.*", "same")


def each_rendering(rows: DataFrame) -> DataFrame:
    """Rows of ``different`` renderings once for each of ``same``."""
    return rows.drop("rep").withColumn("rep", F.explode("same")).drop("same")


def heard_groups(requests: DataFrame, reps: DataFrame, person: DataFrame, index: PersonIndex | None = None) -> tuple[DataFrame, DataFrame]:
    """Records with their group (``cluster``), and a row a group: its name beside the heard one (forms in hf, hl, sf,
    sl), whether the hint fits, and ``most_points``, what its points can't exceed by lengths, sound and hint.

    Both are for ``different`` renderings only; ``same`` of the second tells for which they stand.
    """
    scope = ["request_id", "rep"]
    reps = settle(different(reps))
    grouped = settle(clusters(settle(retrieved(requests, reps, person, index=index)), scope, across=True))
    best = representatives(grouped, [*scope, "cluster"])
    # a group is scored by its directory record's name, else by the helpdesk's
    name = best.groupBy(*scope, "cluster").agg(F.min(F.struct((F.col("source") != DIRECTORY).alias("o"), "first_name", "last_name")).alias("n"))
    heard = name.join(reps, scope).join(requests.select("request_id", blank(F.col("last_name_hint")).alias("hint")), "request_id")
    forms = {"hf": F.col("first"), "hl": F.col("last"), "sf": F.col("n.first_name"), "sl": F.col("n.last_name")}
    heard = heard.select(*scope, "same", "cluster", S.hint_matches(F.col("hint"), F.col("n.last_name")).alias("hinted"), *[S.name_forms(c).alias(k) for k, c in forms.items()])
    return grouped, settle(heard.withColumn("most_points", _points(S.ratio_bound)))


def _points(ratio=S.fuzzy_ratio):
    first, last = (S.match_quality_of(F.col(f"h{part}"), F.col(f"s{part}"), ratio) for part in "fl")
    return S.with_hint(S.stage_points(first, last), F.col("hinted"))


def scored_groups(requests: DataFrame, reps: DataFrame, person: DataFrame) -> DataFrame:
    """(request_id, rep, cluster, record_key, ..., stage_points): all records with their group's points."""
    grouped, heard = heard_groups(requests, reps, person)
    return each_rendering(grouped.join(heard.select("request_id", "rep", "same", "cluster", _points().alias("stage_points")), ["request_id", "rep", "cluster"]))


def bounded_scores(heard: DataFrame, n: int = KEPT_PER_REP) -> DataFrame:
    """(request_id, rep, same, cluster, stage_points) of the groups that may be among the best ``n`` of their rendering.

    The ``n`` groups that could have most points are scored first. The least of their points is a threshold that the
    best ``n`` reach, so of the others only those are scored whose bound isn't below it; the rest have no edit
    distances worked out at all. With fewer than ``n`` groups all are scored.
    """
    scope = ["request_id", "rep"]
    likely = Window.partitionBy(*scope).orderBy(F.col("most_points").desc(), "cluster")
    first = heard.withColumn("nth", F.row_number().over(likely)).filter(F.col("nth") <= n).drop("nth")
    first = settle(first.select(*scope, "same", "cluster", _points().alias("stage_points")))
    reached = first.groupBy(*scope).agg(F.min("stage_points").alias("least"), F.count(F.lit(1)).alias("of")).filter(F.col("of") == n).drop("of")
    rest = heard.join(reached, scope).filter(F.col("most_points") >= F.col("least")).join(first.select(*scope, "cluster"), [*scope, "cluster"], "left_anti")
    return first.unionByName(rest.select(*scope, "same", "cluster", _points().alias("stage_points")))


def best_groups(requests: DataFrame, reps: DataFrame, person: DataFrame, n: int = KEPT_PER_REP, index: PersonIndex | None = None) -> DataFrame:
    """``kept_groups`` of ``scored_groups`` without scoring them all."""
    grouped, heard = heard_groups(requests, reps, person, index)
    best = Window.partitionBy("request_id", "rep").orderBy(F.col("stage_points").desc(), "cluster")
    heads = bounded_scores(heard, n).withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= n).drop("nth")
    return each_rendering(grouped.join(heads, ["request_id", "rep", "cluster"]))


def scoring_report(heard: DataFrame, n: int = KEPT_PER_REP) -> DataFrame:
    """(request_id, rep, groups, scored): how many groups each rendering has and how many of them are scored."""
    scope = ["request_id", "rep"]
    scored = bounded_scores(heard, n).groupBy(*scope).agg(F.count(F.lit(1)).alias("scored"))
    return each_rendering(heard.groupBy(*scope, "same").agg(F.count(F.lit(1)).alias("groups")).join(scored, scope)).select(*scope, "groups", "scored")


def kept_groups(groups: DataFrame, n: int = KEPT_PER_REP) -> DataFrame:
    """The best groups of each rendering; ties go to the smallest cluster key."""
    heads = groups.select("request_id", "rep", "cluster", "stage_points").distinct()
    best = Window.partitionBy("request_id", "rep").orderBy(F.col("stage_points").desc(), "cluster")
    heads = heads.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= n).drop("nth", "stage_points")
    return groups.join(heads, ["request_id", "rep", "cluster"])


def merged_renderings(groups: DataFrame, folded: int = FOLDED) -> DataFrame:
    """``groups`` with ``label``: groups of different renderings of a request are one person if they share a record.

    Requests of up to ``folded`` rows are put together in one row each, the others by joins.
    """
    few, many = split_by_size(groups, ["request_id"], folded)
    together = lambda a, b: (a["record_key"] == b["record_key"]) | ((a["rep"] == b["rep"]) & (a["cluster"] == b["cluster"]))
    made = [] if few is None else [folded_labels(few, ["request_id"], together, "record_key", "label")]
    if many is not None:
        node = lambda *c: F.concat_ws("\x1f", *[F.col(x).cast("string") for x in c])
        both = many.withColumns({"group": node("request_id", "rep", "cluster"), "record": node("request_id", "record_key")})
        links = both.select("group", "record").distinct()
        labels = connected_components(links.select(F.col("group").alias("node")).union(links.select("record")), links)
        made.append(both.join(labels, both["group"] == labels["node"]).drop("node", "group", "record"))
    return made[0] if len(made) == 1 else made[0].unionByName(made[1])


def candidates(requests: DataFrame, person: DataFrame, index: PersonIndex | None = None) -> DataFrame:
    """Up to five scored candidates a request. Requests without a usable rendering have none; see ``match_status``.

    ``index`` is an index of ``person``, if there is one.
    """
    reps = representations(requests)
    merged = settle(merged_renderings(settle(best_groups(requests, reps, person, index=index))))
    final = merged.groupBy("request_id", "label").agg(F.max("stage_points").alias("stage_points"), F.count_distinct("rep").cast("int").alias("hits"), F.min("record_key").alias("first_record"))
    whole = Window.partitionBy("request_id")
    final = final.withColumn("top", F.max("stage_points").over(whole))
    final = final.withColumn("rivals", F.sum((2 * F.col("stage_points") >= F.col("top")).cast("int")).over(whole))
    final = final.join(reps.select("request_id", "total").distinct(), "request_id")
    best = representatives(merged.dropDuplicates(["request_id", "label", "record_key"]), ["request_id", "label"])
    side = lambda s: best.filter(F.col("source") == s).select("request_id", "label", F.col("first_name").alias(f"{s}_first"), F.col("last_name").alias(f"{s}_last"), external_id(F.col("xid"), F.col("id")).alias(f"{s}_xid"))
    final = final.join(side(DIRECTORY), ["request_id", "label"], "left").join(side(HELPDESK), ["request_id", "label"], "left")
    own = F.coalesce("directory_first", F.lit("")) != ""
    first = F.when(own, F.col("directory_first")).otherwise(F.coalesce("helpdesk_first", F.lit("")))
    # both names come from one record
    last = F.when(own | F.col("helpdesk_last").isNull(), F.col("directory_last")).otherwise(F.col("helpdesk_last"))
    final = final.withColumns({"first_name": first, "last_name": F.coalesce(last, F.lit(""))})
    final = final.withColumns({
        "name": F.trim(F.concat_ws(" ", "first_name", "last_name")), "first_phonetic": koelner(normalize_b(F.col("first_name"))), "last_phonetic": koelner(normalize_b(F.col("last_name"))),
        "representation_points": S.representation_points(F.col("hits"), F.col("total")), "uniqueness_points": S.uniqueness_points(F.col("rivals")),
    })
    final = final.withColumn("confidence", F.col("stage_points") + F.col("representation_points") + F.col("uniqueness_points"))
    order = Window.partitionBy("request_id").orderBy(F.col("confidence").desc(), "first_record")
    final = final.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= KEPT)
    return final.select(
        "request_id", "nth", "name", "first_name", "last_name", "first_phonetic", "last_phonetic", F.coalesce("directory_xid", F.lit("")).alias("directory_xid"), F.coalesce("helpdesk_xid", F.lit("")).alias("helpdesk_xid"),
        "stage_points", "representation_points", "uniqueness_points", "confidence",
    )


def match_status(requests: DataFrame) -> DataFrame:
    """(request_id, status): bad_request without a usable rendering, else ok."""
    good = representations(requests).select("request_id").distinct().withColumn("ok", F.lit(True))
    return requests.select("request_id").join(good, "request_id", "left").select("request_id", F.when(F.col("ok"), "ok").otherwise("bad_request").alias("status"))


def requests_of(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Match requests from JSON bodies; fields that the plan has no use for (language, confidence, type) are dropped."""
    return bodies.select(F.from_json(column, MATCH_REQUEST).alias("x")).select("x.*")


def responses(requests: DataFrame, found: DataFrame) -> DataFrame:
    """(request_id, status, body): each request's candidates, in order, as a JSON array."""
    shown = ["nth", "name", "first_name", "last_name", "directory_xid", "helpdesk_xid", "confidence"]
    listed = found.groupBy("request_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*shown)))).alias("body"))
    out = match_status(requests).join(listed, "request_id", "left")
    return out.select("request_id", "status", F.when(F.col("status") == "ok", F.coalesce("body", F.lit("[]"))).alias("body"))

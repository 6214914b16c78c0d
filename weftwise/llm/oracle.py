"""SQL (DuckDB's dialect) for the training-data queries that SQL can express on whole tables."""

from __future__ import annotations

from weftwise.llm.license_scan import BASE, TOP_PRIORITY, _most_words, rules

_WORDS = r"regexp_extract_all(coalesce({0}, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
with docs as (select row_number() over () as r, doc_id, coalesce(text, '') as text, {_WORDS.format("text")} as w from documents),
windows as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as k from (select r, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) >= 5)),
twice as (select r, i from (select r, i, count(*) over (partition by r, k) as n from windows) where n > 1),
marked as (select r, count(distinct i + j) as n from twice cross join range(5) s(j) group by r),
figures as (select d.r, doc_id, text, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
  list_filter(string_split(text, chr(10)), lambda x : regexp_matches(x, '[^\x20\x09-\x0D]')) as lines, coalesce(m.n, 0) as n_repeat_words from docs d left join marked m on m.r = d.r),
judged as (select *, len(lines) - len(list_distinct(lines)) as n_dup_lines, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from figures)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or 10 * n_symbols > 3 * n_words or 10 * (length(text) - length(replace(text, '!', ''))) > 5 * n_words or 10 * n_dup_lines > 3 * len(lines) or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 2 * length(regexp_replace(text, '\P{{L}}+', '', 'g')) < word_chars or regexp_matches(text, '[^\x20\x09-\x0D]{{500}}') or contains(lower(text), 'lorem ipsum')) as kept
from judged"""

_MARK = "replace({0}, '<|', '< |')"
_TURN = f"'<|' || {_MARK.format('role')} || '|>' || chr(10) || {_MARK.format('text')} || '<|end|>' || chr(10)"
_MASK = f"(length({_MARK.format('role')}) + 5)::varchar || ':0,' || length({_MARK.format('text')})::varchar || ':' || (role = 'assistant')::int::varchar || ',8:0'"

PREFERENCES = f"""
with turns as (select conv_id >> 1 as pair_id, conv_id & 1 as side, coalesce(role, 'user') as role, coalesce(text, '') as text, (row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'user'), coalesce(text, '')) - 1)::int as i
  from conversations where conv_id is not null),
sided as (select pair_id, role, text, i, case when min(side) over (partition by pair_id) = 1 then 0 else side end as side, count(*) over (partition by pair_id, side) as n from turns),
shape as (select pair_id, max(n) filter (side = 0) as a, max(n) filter (side = 1) as b from sided group by pair_id),
differs as (select x.pair_id, min(x.i) as i from sided x join sided y on x.pair_id = y.pair_id and x.i = y.i and x.side = 0 and y.side = 1 where x.role <> y.role or x.text <> y.text group by x.pair_id),
cut as (select s.pair_id, b is not null as paired, coalesce(d.i, least(a, coalesce(b, 0)))::int as n from shape s left join differs d on d.pair_id = s.pair_id),
prompts as (select pair_id, string_agg({_TURN}, '' order by i) as said from sided join cut using (pair_id) where side = 0 and i < cut.n group by pair_id),
rests as (select pair_id, side, string_agg({_TURN}, '' order by i) as said, string_agg({_MASK}, ',' order by i) as mask, bool_or(role = 'assistant') as trained from (select s.pair_id, side, role, text, i from sided s join cut c on c.pair_id = s.pair_id where s.i >= c.n) group by pair_id, side)
select c.pair_id, c.n as prefix_turns, coalesce(p.said, '') as prompt, coalesce(x.said, '') as chosen, case when paired then coalesce(y.said, '') end as rejected, coalesce(x.mask, '') as chosen_mask, case when paired then coalesce(y.mask, '') end as rejected_mask,
  paired and coalesce(x.trained, false) and coalesce(y.trained, false) as usable
from cut c left join prompts p on p.pair_id = c.pair_id left join rests x on x.pair_id = c.pair_id and x.side = 0 left join rests y on y.pair_id = c.pair_id and y.side = 1"""


def _base() -> str:
    """Places of the base phrases as rows (r, place, label)."""
    one = "select r, i - 1 as place, '{label}' as label from (select r, w, unnest(range(1, len(w) + 1)) as i from docs where {gate}) where {match}"
    return " union all ".join(
        one.format(label=label, gate=f"list_contains(w, '{phrase[gate]}')", match=" and ".join(f"w[i + {j}] = '{x}'" for j, x in enumerate(phrase))) for phrase, gate, label in BASE
    )


def licenses() -> str:
    """The scan with every rule; a rule's look-around is spelt out, as RE2 has none."""
    made = ", ".join(f"({k}, '{label}', {priority}, '{gate}', ' ({before})$', '^({after}) ', {_most_words(before)}, {_most_words(after)})" for k, label, priority, gate, before, after in rules())
    spaces = "(length({0}) - length(replace({0}, ' ', '')))"
    back, ahead = "regexp_extract(back, before, 0)", "regexp_extract(ahead, after, 0)"
    return rf"""
with rules(k, label, priority, gate, before, after, n_back, n_ahead) as (values {made}),
docs as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
base as ({_base()}),
based as (select r, count(*) as n, min(place) as low, max(place) as high, string_agg(distinct label, ',' order by label) as labels from base group by r),
gates as (select r, w, i, w[i] as gate from (select r, w, unnest(range(1, len(w) + 1)) as i from docs) where w[i] in (select gate from rules)),
around as (select r, i, k, label, priority, before, after, ' ' || case when n_back > 0 and i > 1 then array_to_string(w[greatest(i - n_back, 1) : i - 1], ' ') || ' ' else '' end as back, array_to_string(w[i : i + n_ahead - 1], ' ') || ' ' as ahead from gates join rules using (gate)),
found as (select r, k, label, priority, i - 1 - ({spaces.format(back)} - 1) as start, i - 1 + {spaces.format(ahead)} as stop from around where regexp_matches(back, before) and regexp_matches(ahead, after)),
stays as (select r, label, priority from found d where not exists (select 1 from found e where e.r = d.r and e.start <= d.start and e.stop >= d.stop
  and (e.priority > d.priority or (e.priority = d.priority and (e.stop - e.start > d.stop - d.start or (e.start = d.start and e.stop = d.stop and e.k < d.k)))))),
every as (select r, label from stays union select r, label from base),
named as (select r, string_agg(label, ',' order by label) as labels from every group by r),
strongest as (select r, max(priority) as priority from stays group by r)
select doc_id, len(w) as n_words, coalesce(b.n, 0) as n_base, b.low as first_word, b.high as last_word, coalesce(b.labels, '') as base_labels, coalesce(n.labels, '') as labels,
  greatest(coalesce(s.priority, 0)::double / {TOP_PRIORITY}, case when b.n > 0 then 0.5 else 0.0 end::double) as score
from docs d left join based b on b.r = d.r left join named n on n.r = d.r left join strongest s on s.r = d.r"""


#: All pairs of documents that share a shingle, and the closure of their links.
NEAR = r"""
with recursive docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
shingles as (select distinct doc_id, k from (select doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i : i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as k from docs)),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as s from shingles a join shingles b on a.k = b.k and a.doc_id < b.doc_id group by all),
links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * s >= 75 * (x.n + y.n - s)),
both_ways as (select a, b from links union all select b, a from links),
reach(node, seen) as (select doc_id, doc_id from docs union select reach.node, both_ways.b from reach join both_ways on reach.seen = both_ways.a),
labels as (select node, min(seen) as label from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, label as component_id, label = d.doc_id as kept from docs d join labels on node = d.doc_id left join sizes s on s.doc_id = d.doc_id"""

#: Every 200-byte window of the texts in hexadecimal, by two hashes; what is left is put together from between the runs.
REPEATS = """
with docs as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
windows as (select doc_id, i, hash(substr(h, 2 * i + 1, 400)) as a, hash(substr(h, 2 * i + 1, 400) || 'x') as b from (select doc_id, h, unnest(range(0, n - 199)) as i from docs where n >= 200)),
starts as (select doc_id, i from (select doc_id, i, count(*) over (partition by a, b) as c from windows) where c > 1),
islands as (select doc_id, i, sum(fresh) over (partition by doc_id order by i) as g from (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 200 then 0 else 1 end as fresh from starts)),
runs as (select doc_id, g, min(i) as s, max(i) + 200 as e from islands group by doc_id, g),
cut as (select doc_id, s, e, lead(s) over (partition by doc_id order by s) as next, row_number() over (partition by doc_id order by s) as nth from runs),
rest as (select c.doc_id, count(*) as n_spans, sum(e - s)::bigint as n_removed, min(s) as first, string_agg(substr(h, 2 * e + 1, 2 * (coalesce(next, n) - e)), '' order by s) as tail from cut c join docs d on d.doc_id = c.doc_id group by c.doc_id)
select d.doc_id, d.n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(case when r.doc_id is null then h else substr(h, 1, 2 * first) || tail end)) as kept_sha256 from docs d left join rest r on r.doc_id = d.doc_id"""


PAGES = """
with held as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
leaders as (select payload_digest, min(page_id) as leader from held where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when leader <> page_id then 'revisit' else 'response' end as record_type, case when leader <> page_id then leader end as refers_to, 'ok' as status
from held left join leaders using (payload_digest)"""

_DISTANCES = """
d{r} as materialized (select x.vec_id, x.part, b.entry, sum((x.x - b.c) * (x.x - b.c))::bigint as d from cells x join book{r} b on b.part = x.part and b.pos = x.pos group by all),
code{r} as materialized (select vec_id, part, min((d, entry)) as best from d{r} group by all),"""
_MEANS = """
mean{r} as (select c.part, (c.best[2]) as entry, x.pos, sum(x.x)::bigint as s, count(*) as n from code{r} c join cells x on x.vec_id = c.vec_id and x.part = c.part group by all),
book{next} as materialized (select b.part, b.entry, b.pos, coalesce((m.s - ((m.s % m.n) + m.n) % m.n) // m.n, b.c) as c from book{r} b left join mean{r} m using (part, entry, pos)),"""


def vectors(rounds: int = 4) -> str:
    """The rounds of means spelt out over one row a component."""
    steps = "".join(_DISTANCES.format(r=r) + (_MEANS.format(r=r, next=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
with kept as (select vec_id, label, embedding as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x : x is null or not isfinite(x))) = 0),
cells as materialized (select vec_id, ((i - 1) // (len(e) // 4))::int as part, ((i - 1) % (len(e) // 4))::int as pos, floor(1024 * e[i]::double)::bigint as x from (select vec_id, e, unnest(range(1, len(e) + 1)) as i from kept)),
book0 as materialized (select part, entry, pos, x as c from cells join (select vec_id, (row_number() over (order by vec_id) - 1)::int as entry from kept qualify row_number() over (order by vec_id) <= 256) using (vec_id)),{steps}
coded as (select vec_id, string_agg(printf('%02x', (best[2])::int), '' order by part) as code, sum(best[1])::bigint as error from code{rounds} group by vec_id),
sha as (select sha256(string_agg(c::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from book{rounds})
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (vec_id) cross join sha"""


PHRASES = r"""
with texts as (select row_number() over () as r, coalesce(lang, 'und') as lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-]') as p from documents),
pieces as materialized (select lang, w from (select lang, regexp_extract_all(unnest(p), '[^ 	]+') as w from texts) where len(w) > 0),
said as (select lang, 1 as k, unnest(w) as phrase from pieces
  union all select lang, 2, unnest(list_transform(range(1, len(w)), lambda i : w[i] || ' ' || w[i + 1])) from pieces
  union all select lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i : w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from pieces),
f as materialized (select lang, k, phrase, count(*) as a from said group by all),
total as (select lang, sum(a)::bigint as n from f where k = 1 group by lang),
cand as materialized (select *, string_split(phrase, ' ') as w from f where k > 1 and a >= 10),
cut as (select lang, phrase, k, a, w, unnest(range(1, k)) as c from cand),
parts as (select x.lang, x.phrase, x.k, x.a, x.c, g.a as l, h.a as r, ((1000000::hugeint * x.a * x.a) // (g.a::hugeint * h.a))::bigint as score from cut x
  join f g on g.lang = x.lang and g.phrase = array_to_string(x.w[1 : x.c], ' ') join f h on h.lang = x.lang and h.phrase = array_to_string(x.w[x.c + 1 :], ' ')),
weakest as (select lang, phrase, k, a, l, r, score from parts qualify row_number() over (partition by lang, phrase order by score, c) = 1),
inner_ as (select lang, phrase, max(a) as longer from (select lang, a, unnest([array_to_string(w[1 : 2], ' '), array_to_string(w[2 : 3], ' ')]) as phrase from cand where k = 3) group by all),
ranked as (select x.lang, row_number() over (partition by x.lang order by score desc, x.a desc, x.phrase) as rank, x.phrase, x.a, l, r, score from weakest x left join inner_ i on i.lang = x.lang and i.phrase = x.phrase where longer is null or 100 * longer < 50 * x.a)
select lang, rank, phrase, a, l, r, n, score from ranked join total using (lang) where rank <= 2000"""


ORACLE: dict[str, str] = {
    "op3_license_scan": licenses(), "op4_minhash_near_dup": NEAR, "op5_suffix_dedup": REPEATS, "op8_preference_pairs": PREFERENCES, "op9_quality_rules": QUALITY,
    "op11_warc_round_trip": PAGES, "op12_vector_codes": vectors(), "op13_phrase_collocations": PHRASES,
}  # fmt: skip

"""SQL of the corpus queries that SQL can express, for DuckDB over the same tables."""

from __future__ import annotations

from dwelltail.llm import mixing, quality_ledger, zone_clustering
from dwelltail.plans.registry import hash_sql

_WORD = r"[^\x20\x09-\x0D]"


def _removed(characters: str) -> str:
    return f"length(text) - length(regexp_replace(text, '{characters}', '', 'g'))"


def quality_sql() -> str:
    """Measurements by lists and windows of words; the repeated windows as rows."""
    rules = {r.name: r.fails for r in quality_ledger.RULES}
    bits = " + ".join(f"case when {fails} then {quality_ledger.BIT[name]} else 0 end" for name, fails in rules.items())
    base = " or ".join(f"({rules[n]})" for n in quality_ledger.POLICIES["base"])
    strict = " or ".join(f"({rules[n]})" for n in quality_ledger.POLICIES["v1"])
    size = quality_ledger.WINDOW
    return f"""with texts as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{_WORD}+') as w from documents),
 lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as l from texts),
 places as (select doc_id, w, unnest(range(1, greatest(1, len(w) - {size - 2}))) as i from texts),
 wins as (select doc_id, i, array_to_string(w[i:i + {size - 1}], ' ') as s from places),
 again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) as n from wins) where n > 1),
 covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest(range(i, i + {size})) as p from again) group by doc_id),
 m as (select doc_id, len(w) as n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
  {_removed('[#*$%&|<>]')} as n_symbols, {_removed('[A-Z]')} as n_upper, {_removed('[A-Za-z]')} as n_letters, {_removed('[0-9]')} as n_digits,
  len(l) - len(list_distinct(l)) as n_dup_lines, len(l) as n_lines, coalesce(n, 0) as n_repeat_words,
  len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as n_same_next
  from texts join lines using (doc_id) left join covered using (doc_id))
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({base}) as base_failed,
  not ({strict}) as kept, {bits} as failed from m"""


def mixing_sql(seed: int = 8) -> str:
    """Targets by the water level along the caps, seats by ranking every quotient, the rest by arithmetic on the line."""
    block, cap = mixing.BLOCK_WORDS, mixing.MAX_REPEATS
    weights = ", ".join(map(str, mixing.WEIGHTS))
    one, two = mixing.STRIDES
    name = "coalesce(source, '')"
    return f"""with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}+')) as size,
  {hash_sql(seed, "coalesce(doc_id::varchar, '')")} as draw from documents),
 src as (select source, sum(size)::bigint as source_size from sized group by source),
 ranked as (select *, [{weights}][((row_number() over (order by source nulls last) - 1) % {len(mixing.WEIGHTS)} + 1)::int] as weight from src),
 along as (select *, {cap} * source_size as most, row_number() over (order by {cap} * source_size / weight, source nulls last) as place,
  (sum(source_size) over () - coalesce(sum({cap} * source_size) over (order by {cap} * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
  / (sum(weight) over () - coalesce(sum(weight) over (order by {cap} * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from ranked),
 reached as (select arg_min(level, place) as level from along where level * weight <= most),
 targets as (select source, source_size, least(most::double, r.level * weight) as target from along, reached r),
 blocks as (select round(sum(source_size) / {block})::bigint as n from src),
 ladder as (select source, target / (2 * k + 1) as quotient, k from (select source, target, unnest(range(0, n)) as k from targets, blocks where target > 0)),
 won as (select source, count(*) as seats from (select source, row_number() over (order by quotient desc, source nulls last, k) as r from ladder), blocks where r <= n group by source),
 kept as (select t.*, coalesce(seats, 0) as seats, greatest(1, ceil(source_size / {mixing.SHARD_WORDS}))::bigint as shards
  from targets t left join won w on t.source is not distinct from w.source),
 bins as (select {mixing.BINS} * greatest(1, ceil((coalesce(sum(strlen(text) + 1), 0) // 2) / {mixing.BINS * mixing.SHARD_WORDS}))::bigint as n_bins from documents),
 docs as (select s.*, k.source_size, k.target, k.seats, draw % n_bins % shards as shard from sized s join kept k on s.source is not distinct from k.source cross join bins),
 sh as (select source, shard, sum(size)::bigint as shard_size, any_value(seats) as seats from docs group by source, shard),
 shl as (select source, shard, seats, row_number() over (partition by source order by q desc, shard, k) as r
  from (select *, shard_size / (2 * k + 1) as q from (select *, unnest(range(0, seats)) as k from sh where shard_size > 0))),
 quotas as (select sh.source, sh.shard, shard_size, greatest(1, ceil(shard_size / {block}))::bigint as nb,
  least((select count(*) from shl where shl.source is not distinct from sh.source and shl.shard = sh.shard and shl.r <= shl.seats), ceil(shard_size / {block})::bigint * {cap})::bigint as quota from sh),
 lined as (select d.*, q.nb, q.quota, {hash_sql(seed, "'offset'", name.replace('source', 'd.source'), 'd.shard')} % q.nb as off,
  case when q.nb % {one} = 0 then {two} else {one} end % q.nb as stride,
  sum(size) over (partition by d.source, d.shard order by draw, doc_id, size rows unbounded preceding)::bigint as e
  from docs d join quotas q on d.source is not distinct from q.source and d.shard = q.shard)
 select doc_id, size, source_size, target, case when size = 0 then 0 else list_sum(list_transform(range((e - size) // {block}, (e - 1) // {block} + 1),
  lambda b: (quota // nb + (((b % nb) * stride + off) % nb < quota % nb)::int) * (least(e, (b + 1) * {block}) - greatest(e - size, b * {block})))) end::bigint as taken from lined"""


def owners_sql() -> str:
    """Groups by the text itself; of rows that repeat id and text the first stays."""
    return """with texts as (select doc_id, coalesce(text, '') as t from documents),
 owned as (select t, max(doc_id) as keep_id, count(*) as group_size from texts group by t)
 select doc_id, keep_id, group_size, row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
  from texts join owned using (t)"""


def clustering_sql() -> str:
    """Plain k-means, a table for every round: vectors as rows of whole components."""
    size, scale = zone_clustering.DIMENSIONS, zone_clustering.SCALE
    rounds = [f"""c0 as materialized (select (row_number() over (order by sha256('{zone_clustering.SEED}:' || coalesce(vec_id::varchar, '')), v) - 1)::int as k, v
  from kept order by k limit {zone_clustering.CLUSTERS})"""]
    for i in range(zone_clustering.ROUNDS + 1):
        rounds.append(f"""a{i} as materialized (select row, any_value(vec_id) as vec_id, arg_min(k, (d, k)) as k, min(d) as d from (select row, vec_id, k,
  list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept x cross join c{i} c) group by row)""")
        rounds.append(f"""c{i + 1} as materialized (select c.k, coalesce(m.v, c.v) as v from c{i} c left join (select k, list((s // n - case when s % n < 0 then 1 else 0 end)::bigint order by place) as v
  from (select k, place, sum(v[place])::hugeint as s, count(*) as n from a{i} join kept using (row), range(1, {size + 1}) as r(place) group by k, place) group by k) m on m.k = c.k)""")
    last = zone_clustering.ROUNDS
    return f"""with kept as materialized (select row_number() over () as row, vec_id, list_transform(embedding, lambda c: floor({scale} * c::double)::bigint) as v from embeddings
  where len(embedding) = {size} and len(list_filter(embedding, lambda c: c is not null and isfinite(c))) = {size}),
 {", ".join(rounds[:-1])}
 select vec_id, k as cluster, d as distance, sum(d) over (partition by k)::bigint as cluster_inertia, sum(d) over ()::bigint as inertia,
  sha256(array_to_string(v, ',')) as centroid_sha256 from a{last} join c{last} using (k)"""


ORACLES = {"op2_quality_ledger": quality_sql(), "op8_mixing": mixing_sql(), "op11_patricia_owners": owners_sql(), "op12_zone_clustering": clustering_sql()}

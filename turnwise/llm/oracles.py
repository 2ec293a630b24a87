"""DuckDB SQL for the queries that SQL can express, over the same tables."""

from __future__ import annotations

from turnwise.llm.mixing import MAX_EPOCHS, SEED, WEIGHTS
from turnwise.llm.quality_rules import BASE_REPEAT, BASE_WORDS, RULES, STOP_WORDS, SYMBOLS

WORD = r"[^\x20\x09-\x0D]+"
_BLANKS = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"

_weight = " ".join(f"when {i} then {w}" for i, w in enumerate(WEIGHTS))
MIX = f"""
with sized as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) as size, md5('{SEED}:' || coalesce(cast(doc_id as varchar), 'null')) as key from documents),
src as (select source, sum(size)::bigint as source_size, case (row_number() over (order by source nulls last) - 1) % {len(WEIGHTS)} {_weight} end::bigint as weight from sized group by source),
-- sources in the order in which they reach their caps
ordered as (select *, {MAX_EPOCHS} * source_size as cap, row_number() over (order by {MAX_EPOCHS} * source_size / weight, source nulls last) as r from src),
sums as (select *, sum(source_size) over () as total, coalesce(sum(cap) over (order by r rows between unbounded preceding and 1 preceding), 0) as gone, sum(weight) over (order by r rows between current row and unbounded following) as open from ordered),
first_free as (select min(r) as r0 from sums where weight::hugeint * (total - gone)::hugeint <= cap::hugeint * open::hugeint and cap > 0),
free as (select (total - gone)::bigint as rest, open::bigint as open_weight from sums, first_free where r = r0),
targets as (select sums.source, sums.source_size, case when r0 is null or r < r0 then cap::double else (weight * rest)::double / open_weight::double end as target from sums left join first_free on true left join free on true),
plan as (select *, floor(target)::bigint as quota, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as whole from targets),
run as (select s.doc_id, s.size, p.source_size, p.target, p.whole, p.quota - p.whole * p.source_size as missing, coalesce(sum(s.size) over (partition by s.source order by s.key, s.size rows between unbounded preceding and 1 preceding), 0) as before from sized s join plan p on s.source is not distinct from p.source)
select doc_id, size::bigint as size, source_size, target, (whole * size + greatest(0, least(size, missing - before)))::bigint as taken from run
"""

JACCARD = f"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 3 then list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g, len(w) >= 3 as whole from d),
n as (select doc_id, count(*) as n from s group by doc_id),
hit as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.whole = b.whole and a.doc_id < b.doc_id group by 1, 2),
link as (select a, b from hit join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 90 * (x.n + y.n - k)),
pair as (select a, b from link union select b, a from link),
walk as (select a as doc_id, a as root from pair union select w.doc_id, e.b from walk w join pair e on e.a = w.root),
least_root as (select doc_id, min(root) as root from walk group by doc_id)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(r.root, d.doc_id) as component_id from d left join n using (doc_id) left join least_root r using (doc_id)
"""

_rules = " and ".join(
    part
    for r in RULES
    for part in (
        [f"100 * {r.measure} >= {r.low} * {r.of or 1}"] * (r.low is not None) + [f"100 * {r.measure} <= {r.high} * {r.of or 1}"] * (r.high is not None)
    )
)
_stop = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
QUALITY = f"""
with t as (select doc_id, coalesce(text, '') as text from documents),
w as (select *, regexp_extract_all(text, '{WORD}') as w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) as l from t),
tri as (select doc_id, i, row(w[i], w[i + 1], w[i + 2]) as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from tri) where c > 1),
covered as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
m as (select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars, (length(text) - length(regexp_replace(text, '[{SYMBOLS}]+', '', 'g')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words, len(l) as n_lines,
  len(list_intersect(w, [{_stop}])) as n_stop_words, length(text) - length(regexp_replace(text, '\\p{{L}}+', '', 'g')) as n_letters, length(text) - length(regexp_replace(text, '\\p{{Lu}}+', '', 'g')) as n_capitals,
  len(list_filter(l, lambda x: regexp_matches(x, '^[\\x20\\t]*[-*•]'))) as n_bullet_lines, len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\t\\r]*$'))) as n_ellipsis_lines
  from w left join covered c using (doc_id)),
b as (select *, n_words < {BASE_WORDS} or 100 * n_repeat_words > {BASE_REPEAT} * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and {_rules} as kept from b
"""

WARC = """
with p as (select page_id, coalesce(html, '') as html, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, p.payload_digest, case when f.first is null or f.first = page_id then 'response' else 'revisit' end as record_type, case when f.first <> page_id then f.first end as refers_to
from p left join f on p.payload_digest = f.payload_digest and p.payload_bytes >= 1000
"""

ORACLE_SQL = {"op2_mix_sources": MIX, "op4_jaccard_join": JACCARD, "op7_quality_rules": QUALITY, "op8_warc_index": WARC}

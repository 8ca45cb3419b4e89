"""DuckDB SQL for the queries of this subpackage that SQL can express.

The others (chunked media, trained models, structural secret checks) are tested
against brute force, exact round trips or held-out accuracy.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_NON_BLANK = r"'[^\x20\x09-\x0D]+'"

DECONTAMINATION = f"""
with d as materialized (select doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from documents),
b as (select item_id, regexp_extract_all({_LOWER}, {_ALNUM}) as w from benchmark where item_id is not null),
bw as materialized (select distinct item_id, least(8, len(w)) as n, array_to_string(w[i:i + least(8, len(w)) - 1], ' ') as win from b, lateral (select unnest(range(1, greatest(1, len(w) - 7) + 1)) as i) where len(w) > 0),
dw as (select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as win from d, (select distinct n from bw), lateral (select unnest(range(1, len(w) - n + 2)) as i)),
h as materialized (select doc_id, i, n, item_id from dw join bw using (n, win)),
hit as (select doc_id, count(*) as n_hit from (select distinct doc_id, unnest(range(i, i + n)) as p from h) group by 1),
found as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, cast(item_id as varchar) as item_id from h) group by 1)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join hit using (doc_id) left join found using (doc_id)"""

SUBSTRING_DEDUP = f"""
with d as materialized (select doc_id, regexp_extract_all(coalesce(text, ''), {_NON_BLANK}) as w from documents),
win as materialized (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as k from d, lateral (select unnest(range(1, len(w) - 48)) as i)),
first as (select k, min(doc_id) as least from win group by k),
gone as materialized (select distinct doc_id, unnest(range(i, i + 50)) as p from win join first using (k) where least < doc_id),
kept as (select doc_id, string_agg(word, ' ' order by p) as t from (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as p from d) anti join gone using (doc_id, p) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join (select doc_id, count(*) as n from gone group by 1) using (doc_id) left join kept using (doc_id)"""

JACCARD_JOIN = f"""
with recursive d as materialized (select doc_id, regexp_extract_all({_LOWER}, {_NON_BLANK}) as w from documents),
s as materialized (select distinct doc_id, md5(array_to_string(w[i:i + 2], ' ')) as g from d, lateral (select unnest(range(1, greatest(1, len(w) - 2) + 1)) as i) where len(w) > 0),
n as materialized (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
link as materialized (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 90 * (x.n + y.n - i)),
reach(a, b) as (select a, b from link union select reach.a, link.b from reach join link on reach.b = link.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, cast(least(d.doc_id, coalesce(r.m, d.doc_id)) as bigint) as component_id
from d left join n using (doc_id) left join (select a as doc_id, min(b) as m from reach group by 1) r using (doc_id)"""

SOURCE_MIXING = f"""
with recursive t as materialized (select doc_id, coalesce(source, '') as source, cast(coalesce(len(regexp_extract_all(text, {_NON_BLANK})), 0) as bigint) as n_tokens from documents),
s as materialized (select *, n_tokens / sum(n_tokens) over () as p, sum(n_tokens) over () as total, count(*) over () as k from (select source, count(*) as n_docs, sum(n_tokens) as n_tokens from t group by 1) where n_tokens > 0),
even(i, lo, hi) as (select 0, 0.0::double, 8.0::double union all
  select i + 1, case when h <= 0.95 * ln(k) + 1e-12 then lo else mid end, case when h <= 0.95 * ln(k) + 1e-12 then mid else hi end
  from (select i, lo, hi, mid, k, ln(sum(p ** mid)) - sum(p ** mid * mid * ln(p)) / sum(p ** mid) as h from (select *, (lo + hi) / 2 as mid from even where i < 55), s group by all)),
rare(i, lo, hi) as (select 0, 0.0::double, 1.0::double union all
  select i + 1, case when r <= 4 then lo else mid end, case when r <= 4 then mid else hi end
  from (select i, lo, hi, mid, max(p ** mid / p) / sum(p ** mid) as r from (select *, (lo + hi) / 2 as mid from rare where i < 55), s group by all)),
x as (select greatest((select case when hi < 1e-12 then 0 else hi end from even where i = 55), (select case when hi < 1e-12 then 0 else hi end from rare where i = 55)) as e),
w as materialized (select source, n_docs, n_tokens as total_tokens, p ** e / sum(p ** e) over () as weight, cast(round(p ** e / sum(p ** e) over () * total) as bigint) as quota from s, x),
q as materialized (select source, weight, cast(ceil(n_docs / 512) as bigint) as blocks, quota // total_tokens as full_epochs, quota % total_tokens as part from w),
placed as materialized (select t.*, q.*exclude (source), cast('0x' || substr(md5('mix:' || source || ':' || coalesce(cast(doc_id as varchar), '-' || n_tokens)), 1, 8) as bigint) % blocks as block from t join q using (source)),
b as (select *, unnest(range(0, cast(full_epochs + 1 as bigint))) as epoch from (select source, block, full_epochs, part, sum(n_tokens) as tokens from placed group by all)),
r as (select *, row_number() over (partition by source, epoch order by md5('mix:' || epoch || ':' || source || ':' || block), block) as block_rank,
  sum(tokens) over (partition by source, epoch order by md5('mix:' || epoch || ':' || source || ':' || block), block rows unbounded preceding) - tokens as before from b),
o as (select source, weight, epoch, block_rank, before, full_epochs, placed.part, doc_id, n_tokens,
  row_number() over v as rank, before + sum(n_tokens) over (v rows unbounded preceding) as until
  from placed join (select source, block, epoch, block_rank, before from r where epoch < full_epochs or before < part) using (source, block)
  window v as (partition by source, epoch, block order by md5('mix:' || epoch || ':' || source || ':' || doc_id), cast(doc_id as varchar), n_tokens))
select source, round(weight, 9) as weight, epoch, cast(block_rank as int) as block_rank, cast(rank as int) as rank, doc_id, n_tokens from o where epoch < full_epochs or until <= part"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mixing": SOURCE_MIXING,
        "op5_decontamination": DECONTAMINATION,
        "op8_substring_dedup": SUBSTRING_DEDUP,
        "op10_ngram_jaccard_join": JACCARD_JOIN,
    }

"""DuckDB SQL for the queries SQL can express, over the same tables.

Nothing is imported from the operators: the patterns and limits are written
out here a second time.
"""

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP1 = rf"""
with d as (select doc_id, coalesce(text, '') as text, {WORDS} as w from documents),
grams as (
  select doc_id, i, w[i:i + 7] as g from (
    select doc_id, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)),
again as (
  select doc_id, i, count(*) over (partition by doc_id, g) as n from grams),
covered as (
  select doc_id, count(distinct i + k) as n_repeat
  from again, range(8) t(k) where n > 1 group by doc_id),
lines as (
  select doc_id, count(*) - count(distinct line) as n_dup from (
    select doc_id, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
c as (
  select doc_id, cast(len(w) as bigint) as n_words,
    cast(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup, 0) as bigint) as n_dup_lines,
    cast(coalesce(n_repeat, 0) as bigint) as n_repeat_words,
    length(regexp_replace(text, '[^!]', '', 'g')) as bangs,
    length(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) as uppers,
    len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) as stutters,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) as n_lines,
    len(list_filter(w, lambda x: lower(x) in (
      'the', 'of', 'and', 'to', 'in', 'a', 'is', 'that', 'for', 'it', 'was', 'on', 'be', 'with', 'as', 'by', 'this',
      'der', 'die', 'und', 'das', 'den', 'von', 'zu', 'mit', 'des', 'im', 'auf', 'ist', 'nicht', 'ein', 'eine', 'für',
      'de', 'la', 'le', 'et', 'les', 'en', 'un', 'une', 'du', 'que', 'est', 'dans', 'pour', 'sur', 'par', 'au',
      'el', 'los', 'y', 'las', 'por', 'con', 'para', 'se', 'del', 'al', 'lo', 'su', 'no'))) as stops
  from d left join lines using (doc_id) left join covered using (doc_id)),
v as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from c)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed
  and word_chars >= 2 * n_words and word_chars <= 20 * n_words
  and 100 * n_symbols <= 5 * word_chars
  and not (n_words >= 60 and 100 * stops < 2 * n_words)
  and 100 * n_dup_lines <= 60 * n_lines
  and 100 * stutters <= 30 * n_words
  and 100 * uppers <= 50 * word_chars
  and 100 * bangs <= 30 * n_words as kept
from v
"""

OP3 = rf"""
with d as (
  select doc_id, source, cast(len({WORDS}) as bigint) as size,
    cast('0x' || substr(md5('17:' || coalesce(cast(doc_id as varchar), '')), 1, 15) as bigint) as h
  from documents),
s0 as (select source, cast(sum(size) as bigint) as source_size from d group by source),
s as (select *, case (row_number() over (order by source nulls last) - 1) % 3 when 0 then 3 when 1 then 1 else 2 end as weight from s0),
-- the water level: sources in the order in which they fill up
f as (
  select *, 1.5::double * sum(source_size) over () as goal,
    coalesce(sum(2.0::double * source_size) over (o rows between unbounded preceding and 1 preceding), 0) as capped,
    sum(weight) over () - coalesce(sum(weight) over (o rows between unbounded preceding and 1 preceding), 0) as left_over
  from s window o as (order by 2.0::double * source_size / weight, source nulls last)),
lvl as (
  select coalesce(arg_min((goal - capped) / left_over, 2.0::double * source_size / weight), 0) as level
  from f where 2.0::double * source_size / weight >= (goal - capped) / left_over),
t as (select source, source_size, weight, least(weight * level, 2.0::double * source_size)::double as target from s, lvl),
q as (select cast(round_even(sum(target) / 64, 0) as bigint) as seats from t),
quot as (
  select source, source_size, target, k, target / 64 / (2 * k + 1) as quotient
  from t, lateral unnest(range(cast(ceil(source_size * 2.0::double / 64) as bigint))) u(k)),
won as (
  select source, count(*) as seats from (
    select source, row_number() over (order by quotient desc, source nulls last, k) as place from quot)
  where place <= (select seats from q) group by source),
src as (
  select t.*, coalesce(w.seats, 0) as seats, greatest(1, cast(ceil(t.source_size / 2000000) as bigint)) as shards
  from t left join won w on t.source is not distinct from w.source),
e as (
  select d.*, src.source_size, src.target, src.seats, d.h % src.shards as shard
  from d join src on d.source is not distinct from src.source),
cell as (select source, shard, any_value(source_size) as ss, any_value(seats) as seats, sum(size)::bigint as cell from e group by source, shard),
cq as (
  select source, shard, cell, seats, k, seats::double * cell / greatest(ss, 1) / (2 * k + 1) as quotient
  from cell, lateral unnest(range(cast(ceil(cell * 2.0::double / 64) as bigint))) u(k)),
quota as (
  select source, shard, count(*) as n from (
    select *, row_number() over (partition by source order by quotient desc, shard, k) as place from cq)
  where place <= seats group by source, shard),
tape as (
  select e.*, c.cell, least(coalesce(quota.n, 0) * 64, 2 * c.cell) as quota_words,
    coalesce(sum(size) over (partition by e.source, e.shard order by e.h, e.doc_id, e.size rows between unbounded preceding and 1 preceding), 0) as start
  from e join cell c on e.source is not distinct from c.source and e.shard = c.shard
  left join quota on e.source is not distinct from quota.source and e.shard = quota.shard)
select doc_id, size, source_size, target,
  cast(case when cell = 0 then 0 else size * (quota_words // cell)
    + greatest(0, least(size, quota_words % cell - start)) end as bigint) as taken
from tape
"""

OP5 = """
with recursive d as (
  select row_number() over () as rid, doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
    cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')), 1, 15) as bigint) as h
  from documents),
-- the rows of buckets that exist; the ones over the limit go one bit deeper
b(depth, rid, prefix, shard_bytes, over) as (
  select 0, rid, 0::bigint, (sum(n_bytes) over ())::bigint,
    sum(n_bytes) over () > 1048576 and min(h) over () < max(h) over ()
  from d
  union all
  select b.depth + 1, b.rid, d.h >> (60 - b.depth - 1),
    (sum(d.n_bytes) over (partition by d.h >> (60 - b.depth - 1)))::bigint,
    sum(d.n_bytes) over (partition by d.h >> (60 - b.depth - 1)) > 1048576
      and min(d.h) over (partition by d.h >> (60 - b.depth - 1)) < max(d.h) over (partition by d.h >> (60 - b.depth - 1))
  from b join d using (rid) where b.over)
select doc_id, n_bytes, case when depth = 0 then '' else lpad(bin(prefix), depth, '0') end as shard,
  depth, shard_bytes
from b join d using (rid) where not over
"""

OP6 = rf"""
with d as (select row_number() over () as rid, doc_id, {WORDS} as w from documents),
win as (
  select rid, i, md5(array_to_string(w[i:i + 34], ' ')) as g from (
    select rid, w, unnest(range(1, len(w) - 33)) as i from d where len(w) >= 35)),
again as (select g from win group by g having count(*) > 1),
hit as (select rid, i from win semi join again using (g)),
-- starts in order; a word goes if a start lies in the 35 positions up to it
word as (select rid, unnest(range(1, len(w) + 1)) as k, unnest(w) as word from d),
flagged as (
  select rid, k, word, max(i) over (partition by rid order by k rows between 34 preceding and current row) is not null as gone
  from (select word.*, hit.i from word left join hit on word.rid = hit.rid and word.k = hit.i)),
kept as (
  select rid, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by k) filter (not gone) as text
  from flagged group by rid)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from d left join kept using (rid)
"""

OP8 = """
with recursive v as (
  select row_number() over () as rid, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
ok as (
  select rid, vec_id, label, e, sqrt(list_dot_product(e, e)) as n from v
  where label is not null and e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
link as (
  select a.rid as a, b.rid as b, b.vec_id as id from ok a join ok b on a.label = b.label and a.rid <> b.rid
  where list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(rid, hop) as (select rid, rid from v union select reach.rid, link.b from reach join link on reach.hop = link.a),
comp as (select reach.rid, min(v.vec_id) as component_id from reach join v on v.rid = reach.hop group by reach.rid),
n as (select a as rid, count(*) as n_links from link group by a)
select vec_id, cast(coalesce(n_links, 0) as bigint) as n_links, component_id,
  coalesce(vec_id = component_id, false) as kept
from v join comp using (rid) left join n using (rid)
"""

OP11 = """
with recursive t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as n
  from conversations where conv_id is not null),
-- unsigned crc32 of the decimal digits, bit by bit
conv as (
  select c, xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(c::varchar, ''),
    lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda r, x: xor(xor(r, x) >> 1, 3988292384::bigint * (xor(r, x) & 1))), 4294967295::bigint) % 9 as h
  from (select distinct c from t)),
-- (conversation, depth, turn) as rebuilt
heads as (
  select conv.c, t.n as d, t.role, t.text from conv join t on t.c = conv.c - conv.c % 5 where t.n <= conv.h),
taken as (select conv.c, conv.h, count(heads.d) as k from conv left join heads on heads.c = conv.c group by all),
turn as (
  select * from heads union all
  select t.c, k + t.n - h, t.role, t.text from t join taken on t.c = taken.c where t.n > h),
path as (
  select c, d, strlen(text) as bytes,
    md5(string_agg(md5(role) || md5(text), '') over (partition by c order by d rows between unbounded preceding and current row)) as node
  from turn
  union all select c, 0, 0, '' from conv),
last as (select c, max(d) as d from path group by c),
up as (select p.c, p.d, p.node, q.node as parent from path p left join path q on q.c = p.c and q.d = p.d - 1),
node as (
  select path.node, any_value(path.d) as depth, any_value(bytes) as bytes, count(*) as n_convs, min(path.c) as conv_id,
    coalesce(string_agg(path.c::varchar, ',' order by path.c) filter (last.d = path.d), '') as ends
  from path join last on last.c = path.c group by path.node),
edge as (select distinct node, parent from up where parent is not null),
kids as (select parent as node, count(*) as n from edge group by parent),
-- every node below, found along the conversations that pass both
below as (
  select distinct a.node as top, b.node from path a join path b on a.c = b.c and a.d <= b.d),
sums as (
  select top as node, count(*) filter (kids.n is null) as n_leaves, sum((node.n_convs - 1) * node.bytes) as saved
  from below join node using (node) left join kids using (node) group by top)
select node.conv_id, node.depth, p.conv_id as parent_conv_id, node.n_convs, coalesce(kids.n, 0)::bigint as n_children,
  sums.n_leaves, sums.saved::bigint as saved_tokens, sha256(node.ends) as ends_sha256
from node join sums using (node) left join kids using (node) left join edge on edge.node = node.node
left join node p on p.node = edge.parent
"""

OP12 = r"""
with low as (
  select row_number() over () as rid, doc_id,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
item as (
  select item_id, row_number() over () as rid,
    list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
asked as (
  select distinct item_id, m, md5(array_to_string(w[i:i + m - 1], ' ')) as g from (
    select item_id, w, least(len(w), 10) as m, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)),
place as (
  select rid, m, i, md5(array_to_string(w[i:i + m - 1], ' ')) as g from (
    select rid, w, m, unnest(range(1, len(w) - m + 2)) as i from low, (select distinct m from asked) where len(w) >= m)),
found as (select rid, i, asked.m, item_id from place join asked on place.m = asked.m and place.g = asked.g),
hit as (select rid, count(distinct i + k) as n_hit from found, lateral unnest(range(m)) u(k) group by rid),
ids as (
  select rid, count(*) as n_items, string_agg(id, ',' order by id) as ids from (
    select distinct rid, item_id, item_id::varchar as id from found) group by rid)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from low left join hit using (rid) left join ids using (rid)
"""

ORACLE = {"op1_quality_rules": OP1, "op3_mixing": OP3, "op5_sharding": OP5, "op6_substring": OP6, "op8_embeddings": OP8,
          "op11_prefix_trie": OP11, "op12_decontamination": OP12}

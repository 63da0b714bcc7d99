"""SQL that DuckDB runs on the given tables, for the corpus queries that SQL can express."""

_FIELD = "coalesce(strlen({0}::varchar) || ':' || {0}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII text, bit by bit: the remainder of its bytes by the reversed polynomial."""
    step = "case when (c & 1) = 1 then xor(c >> 1, 3988292384) else c >> 1 end"
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda s: ascii(s)::bigint)), lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::bigint[], lambda c, i: {step})), 4294967295)"


#: The rule word for word: levels by recursion, then a walk from each leaf up through both trees.
MERKLE_SQL = f"""
with recursive docs as (
  select doc_id, coalesce('g' || lang, '-') grp, {_leaf('n_chars')} leaf,
         case when {_crc32('doc_id::varchar')} % 7 = 0 and n_chars is not null then {_leaf('(n_chars + 1)')} end forged
  from documents),
placed as (select *, row_number() over (partition by grp order by doc_id, leaf) - 1 pos from docs),
node as (
  select grp, 0 as lvl, pos, leaf as h from placed
  union all
  select grp, lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos))
  from (select *, count(*) over (partition by grp) as c from node) where c > 1 group by grp, lvl, pos // 2),
sub as (select grp, arg_max(h, lvl) as h, max(lvl) as levels, row_number() over (order by grp) - 1 as place from node group by grp),
top as (
  select 0 as lvl, row_number() over (order by grp) - 1 as pos, h from sub
  union all
  select lvl + 1, pos // 2, sha256(string_agg(h, '' order by pos))
  from (select *, count(*) over () as c from top) where c > 1 group by lvl, pos // 2),
level as (
  select grp, lvl, pos, n.h from node n join sub s using (grp) where lvl < levels
  union all
  select s.grp, s.levels + t.lvl, t.pos, t.h from top t, sub s),
deep as (select max(lvl) as n from top),
walk as (
  select doc_id, p.grp, leaf, case when levels = 0 then place else pos end as pos, 0 as lvl, coalesce(forged, leaf) as cur, '' as beside
  from placed p join sub s using (grp)
  union all
  select w.doc_id, w.grp, leaf,
         case when w.lvl + 1 = s.levels then s.place else w.pos // 2 end, w.lvl + 1,
         sha256(case when w.pos % 2 = 0 then w.cur || coalesce(l.h, '') else l.h || w.cur end), w.beside || coalesce(l.h, '')
  from (select *, case when pos % 2 = 0 then pos + 1 else pos - 1 end as other from walk) w
  join sub s on s.grp = w.grp
  left join level l on l.grp = w.grp and l.lvl = w.lvl and l.pos = w.other
  where w.lvl < s.levels + (select n from deep))
select w.doc_id, w.leaf, s.h as subroot, (select arg_max(h, lvl) from top) as root, sha256(w.beside) as proof_sha256,
       w.cur as folded_root, w.cur = (select arg_max(h, lvl) from top) as verified
from walk w join sub s using (grp) where w.lvl = s.levels + (select n from deep)
"""

#: Every anchor against every row.
NEGATIVES_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pair as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
         list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::bigint as score
  from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
pos as (select * from pair where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.vec_id as positive_id, row_number() over w as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from pos p join pair n on n.anchor_id = p.anchor_id and not n.same and 50 * p.score <= 100 * n.score and 100 * n.score <= 95 * p.score
window w as (partition by p.anchor_id, p.vec_id order by n.score desc, n.vec_id)
qualify row_number() over w <= 3
"""

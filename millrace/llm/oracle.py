"""DuckDB SQL that says the same as those queries that SQL can express."""

OP9 = """
with d as (select doc_id, coalesce(text, '') as text, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, hash(substr(h, 2 * p + 1, 800)) as k from (select doc_id, h, unnest(range(cast(length(h) // 2 - 399 as bigint))) as p from d where length(h) >= 800)),
hot as (select k from w group by k having count(*) > 1),
s as (select doc_id, p, lag(p) over (partition by doc_id order by p) as before from w where k in (select k from hot)),
runs as (select doc_id, p, sum(case when before is null or p > before + 400 then 1 else 0 end) over (partition by doc_id order by p) as run from s),
spans as (select doc_id, min(p) as low, max(p) + 400 as high from runs group by doc_id, run),
edges as (select doc_id, low, high, coalesce(lag(high) over (partition by doc_id order by low), 0) as last from spans),
cut as (select e.doc_id, sum(high - low) as n_removed, count(*) as n_spans, string_agg(substr(h, 2 * last + 1, 2 * (low - last)), '' order by low) || substr(any_value(h), 2 * max(high) + 1) as kept
        from edges e join d on e.doc_id = d.doc_id group by e.doc_id)
select d.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join cut on d.doc_id = cut.doc_id"""
OP10 = """
with d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
t as (select doc_id, i, words[i] as w, case when i > 1 then words[i - 1] end as v, case when i > 2 then words[i - 2] end as u from (select doc_id, words, unnest(range(1, len(words) + 1)) as i from d)),
n1 as (select w, count(*) as n from t group by 1), d1 as (select doc_id, w, count(*) as n from t group by 1, 2),
n2 as (select v, w, count(*) as n from t where v is not null group by 1, 2), d2 as (select doc_id, v, w, count(*) as n from t where v is not null group by 1, 2, 3),
n3 as (select u, v, w, count(*) as n from t where u is not null group by 1, 2, 3), d3 as (select doc_id, u, v, w, count(*) as n from t where u is not null group by 1, 2, 3, 4),
r1 as (select doc_id, w, n1.n - d1.n as n from d1 join n1 using (w)), r2 as (select doc_id, v, w, n2.n - d2.n as n from d2 join n2 using (v, w)), r3 as (select doc_id, u, v, w, n3.n - d3.n as n from d3 join n3 using (u, v, w)),
s as (select t.doc_id, greatest(sum(1) over () - len(d.words), 1) as others, a.n as c1, coalesce(b.n, 0) as c2, coalesce(c.n, 0) as c3, coalesce(x.n, 0) as x1, coalesce(y.n, 0) as x2
  from t join d on t.doc_id = d.doc_id join r1 a on t.doc_id = a.doc_id and t.w = a.w left join r2 b on t.doc_id = b.doc_id and t.v = b.v and t.w = b.w left join r3 c on t.doc_id = c.doc_id and t.u = c.u and t.v = c.v and t.w = c.w
  left join r1 x on t.doc_id = x.doc_id and t.v = x.w left join r2 y on t.doc_id = y.doc_id and t.u = y.v and t.v = y.w),
r as (select doc_id, count(*) as n_words, sum(case when c3 > 0 then ln(c3 / greatest(x2, c3)) when c2 > 0 then ln(c2 / greatest(x1, c2)) + ln(0.4::double) else ln(greatest(c1, 0.5) / others) + 2 * ln(0.4::double) end) as log_score, count(*) filter (c3 <= 0) as n_backoff from s group by 1)
select d.doc_id, coalesce(n_words, 0) as n_words, round(coalesce(log_score, 0), 6) as log_score, round(log_score / n_words, 9) as mean_log_score, coalesce(n_backoff, 0) as n_backoff from d left join r on d.doc_id = r.doc_id"""
HOST = r"translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
PATH = r"coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '')"
OP3 = rf"""
with p as (select page_id, url, {HOST} as host, {PATH} as path, coalesce(regexp_extract(url, '[?]([^#]*)', 1), '') as query from pages),
k as (select page_id, host, path, list_distinct(list_concat(
    list_transform(list_filter(string_split(host, '.'), lambda x: x <> ''), lambda x: 'host=' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(path), '[0-9]+', '0', 'g'), '[/.]'), lambda x: x <> ''), lambda x: 'path=' || x),
    list_transform(list_filter(regexp_split_to_array(regexp_replace(lower(query), '[0-9]+', '0', 'g'), '[&;]'), lambda x: x <> ''), lambda x: 'query=' || x),
    case when contains(url, '#') then ['fragment'] else [] end)) as tokens from p),
l as (select row_number() over () as r, tokens, coalesce(quality = 0 or toxic = 1, false) as blocked from k join labels on page_id = doc_id where len(tokens) > 0),
e as (select r, blocked, unnest(tokens) as t from l),
c as (select blocked, [t] as needed from e
  union all select a.blocked, [a.t, b.t] from e a join e b on a.r = b.r and a.t < b.t
  union all select a.blocked, [a.t, b.t, c.t] from e a join e b on a.r = b.r and a.t < b.t join e c on a.r = c.r and b.t < c.t
  union all select a.blocked, [a.t, b.t, c.t, d.t] from e a join e b on a.r = b.r and a.t < b.t join e c on a.r = c.r and b.t < c.t join e d on a.r = d.r and c.t < d.t),
m as (select needed from c group by needed having count(*) filter (blocked) >= greatest(20, 0.001 * (select count(*) from l)) and count(*) filter (blocked) / count(*) >= 0.6),
g as (select * from (values ('example.com', '/en/7', 'allow'), ('example.net', '/de/8', 'block'), ('com', '/en/', 'block'), ('net', '/de/', 'block'), ('org', '/es/', 'block')) g(h, q, v)),
f as (select k.*, (select {{'rule': h || q, 'verdict': v}} from g where (host = h or ends_with(host, '.' || h)) and starts_with(path, q) order by length(h || q) desc limit 1) as found,
  exists (select 1 from m where list_has_all(tokens, needed)) as hit from k)
select page_id, host, path, found.rule as rule, coalesce(found.verdict, case when hit then 'block' else 'allow' end) as verdict from f"""


def _crc(x: str) -> str:
    """The unsigned crc32 of a number's decimal text, bit by bit."""
    return f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(cast({x} as varchar), ''), lambda s: ascii(s)::bigint)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda d, e: xor(d >> 1, (d & 1) * 3988292384))), 4294967295)"


#: Levels of a tree that the SQL writes out: up to 16 ** 6 leaves.
LEVELS = 6


def _op11() -> str:
    """Nodes level by level, then each leaf's siblings and its fold; a tree stops at one node."""
    part = lambda c: f"coalesce(strlen(cast({c} as varchar)) || ':' || {c}, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    both = lambda text: "sha256(" + " || ".join(part(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    sql = f"""
with base as (select doc_id, case when source is null then '' else '=' || source end as tree, {both("text")} as leaf, {both(lower)} as bent, row_number() over () as r from documents),
l as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf, r) - 1 as i, count(*) over (partition by tree) as n from base),
a0 as (select tree, i, leaf as h from l)"""

    def levels(x: str, last: str) -> str:
        out = ""
        for k in range(LEVELS):
            out += f""",
{x}r{k} as (select tree, i // 16 as i, list(h order by i) as hs from {x}{k} where tree in (select tree from {x}{k} group by tree having count(*) > 1) group by 1, 2),
{x}{k + 1} as (select tree, i, sha256(array_to_string(hs, '')) as h from {x}r{k})"""
        return out + f""",
{last} as (select tree, h from ({" union all ".join(f"select tree, h, {k} as k from {x}{k}" for k in range(LEVELS + 1))}) qualify row_number() over (partition by tree order by k desc) = 1)"""

    def climb(x: str, rows: str, before: str) -> str:
        out, last = "", before
        for k in range(LEVELS):
            step = f"{rows}{k + 1}"
            at = f"p.{x}i // {16**k} % 16 + 1"
            out += f""",
{step} as (select p.* replace (p.proof || coalesce(array_to_string(list_filter(hs, lambda h, j: j <> {at}), ''), '') as proof, coalesce(sha256(array_to_string(list_transform(hs, lambda h, j: case when j = {at} then p.fold else h end), '')), p.fold) as fold)
  from {last} p left join {x}r{k} q on q.tree = p.{x}tree and q.i = p.{x}i // {16 ** (k + 1)})"""
            last = step
        return out

    sql += levels("a", "tops") + ", b0 as (select '' as tree, row_number() over (order by tree) - 1 as i, h from tops)" + levels("b", "roots")
    sql += f""",
c0 as (select doc_id, leaf, l.tree as atree, l.i as ai, '' as btree, t.i as bi, t.h as subroot, '' as proof, case when {_crc("doc_id")} % 5 = 0 then bent else leaf end as fold
  from l join (select tree, h, row_number() over (order by tree) - 1 as i from tops) t on l.tree = t.tree)"""
    sql += climb("a", "c", "c0") + climb("b", "e", f"c{LEVELS}")
    return sql + f" select doc_id, leaf, subroot, (select h from roots) as root, sha256(proof) as proof_sha256, fold as folded_root, fold = (select h from roots) as verified from e{LEVELS}"


OP11 = _op11()
OP12 = rf"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i, struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) as s from conversations where conv_id is not null),
o as (select conv_id, list(s order by i) as turns, {_crc("conv_id")} % 4 as h from t group by conv_id),
r as (select o.conv_id, list_concat(coalesce(g.turns[1:o.h], []), o.turns[o.h + 1:]) as path from o left join o g on g.conv_id = o.conv_id - o.conv_id % 20),
m as (select conv_id, path, unnest(range(len(path) + 1)) as depth from r),
k as (select depth, path[1:depth] as key, min(conv_id) as conv_id, count(*) as n_convs, string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (len(path) = depth) as ends from m group by 1, 2),
v as (select k.*, p.conv_id as parent_conv_id, (k.n_convs - 1) * case when k.depth = 0 then 0 else len(regexp_extract_all(k.key[k.depth].t, '[^\x20\x09-\x0D]+')) end as saved from k left join k p on p.depth = k.depth - 1 and p.key = k.key[1:k.depth - 1]),
c as (select parent_conv_id as conv_id, depth - 1 as depth, count(*) as n from v where depth > 0 group by 1, 2),
w as (select v.*, coalesce(c.n, 0) as n_children from v left join c on c.conv_id = v.conv_id and c.depth = v.depth),
a as (select unnest(range(depth + 1)) as top, key, saved, n_children from w),
s as (select top, key[1:top] as key, count(*) filter (n_children = 0) as n_leaves, cast(sum(saved) as bigint) as saved_tokens from a group by 1, 2)
select w.conv_id, w.depth, w.parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, sha256(coalesce(w.ends, '')) as ends_sha256 from w join s on s.top = w.depth and s.key = w.key"""
OP13 = r"""
with e as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -7, i, case when i = 0 then 'user' else 'assistant' end, '\### Assistant: </turn> ok' from range(2) x(i)),
l as (select *, length(regexp_replace(replace(role, '\', '\\'), '<(/?turn>|text>)', '<\\\1', 'g')) + length(regexp_replace(replace(text, '\', '\\'), '<(/?turn>|text>)', '<\\\1', 'g')) + 20 as chars, row_number() over w as i, count(*) over (partition by conv_id) as n from e window w as (partition by conv_id order by turn nulls first, role, text)),
p as (select *, sum(chars) over (partition by conv_id order by i) as upto from l)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by i)) as turns_sha256, cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by i) filter (role = 'assistant'), '')) as loss_sha256, cast(sum(upto) filter (role = 'assistant' or i = n) as bigint) as formatted_chars, count(*) filter (role = 'assistant' or i = n) as n_examples
from p group by conv_id"""

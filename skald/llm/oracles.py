"""DuckDB SQL of the queries that SQL expresses."""

from __future__ import annotations

#: Sets of 3-word shingles, pairs by shared shingles, and components by recursion.
OP4 = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) >= 3 then list_distinct([ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)]) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end as shingles from w),
e as (select doc_id, len(shingles) as n, unnest(shingles) as g from s),
p as (select a.doc_id as x, b.doc_id as y, a.n + b.n as total, count(*) as shared from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2, 3),
l as (select x, y from p where 100 * shared >= 90 * (total - shared)),
sides as (select x as a, y as b from l union select y, x from l),
r(node, root) as (select a, a from sides union select sides.b, r.root from r join sides on sides.a = r.node),
c as (select node, min(root) as root from r group by node)
select doc_id, len(shingles) as n_shingles, coalesce(root, doc_id) as component_id from s left join c on node = doc_id"""

#: Equal words of a document and an item lie on diagonals; along each, the window with most of them counts.
OP9 = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from documents),
i as (select item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as ws from benchmark),
x as (select doc_id, len(ws) as nx, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as p from d),
y as (select item_id, len(ws) as ny, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as q from i),
m as (select doc_id, item_id, p - q as shift, q, least(13, ny) as n, greatest(0, q - p) as low, least(ny, nx - (p - q)) as high from x join y using (word)),
t as (select *, count(*) over (partition by doc_id, item_id, shift order by q range between current row and 12 following) as ahead, count(*) over (partition by doc_id, item_id, shift) as every_ from m where high - low >= n),
b as (select doc_id, item_id, shift, n, max(case when n = ny_all then every_ when q + n <= high then ahead end) as inner_, count(*) filter (where q >= high - n) as last_ from (select *, case when n < 13 then n else -1 end as ny_all from t) group by 1, 2, 3, 4)
select doc_id, item_id, max(greatest(coalesce(inner_, 0), last_)) as n_agree, max(n) as n_window from b group by 1, 2 having 100 * max(greatest(coalesce(inner_, 0), last_)) >= 80 * max(n)"""


#: The checksum byte by byte over a table; near words by patterns with one place left open or out; roots by recursion.
OP11 = r"""
with recursive bits(i, k, c) as (select i, 0, i from range(256) t(i) union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from bits where k < 8),
tab as (select list(c order by i) as t from bits where k = 8),
runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) as w from documents),
each as (select doc_id, w, count(*) as n, hex(encode(doc_id || ':' || w)) as x from runs where length(w) >= 6 group by doc_id, w),
crc as (select w, n, xor(list_reduce(list_prepend(4294967295::bigint, [('0x' || x[2 * k + 1:2 * k + 2])::bigint for k in range(length(x) // 2)]), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) as h from each, tab),
words as (select case when h % 199 = 0 then left(w, h % length(w)) || substring(w, h % length(w) + 2) else w end as word, sum(n)::bigint as n from crc group by 1 having length(word) >= 6 and sum(n) >= 5),
places as (select word, n, unnest(range(length(word))) as p from words),
gone as (select word, n, left(word, p) as a, substring(word, p + 2) as b from places),
pairs as (select x.word, y.word as near, y.n as m from gone x join gone y on x.a = y.a and x.b = y.b and x.word <> y.word
  union select x.word, y.word, y.n from gone x join words y on x.a || x.b = y.word union select y.word, x.word, x.n from gone x join words y on x.a || x.b = y.word),
best as (select word, count(*) as n_near, max(m) as m, min(near order by near) filter (where m = top) as near from (select *, max(m) over (partition by word) as top from pairs) group by word),
told as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then near end as form, case when m >= 5 * n then m end as form_n from words w left join best using (word)),
path(word, at_, depth) as (select word, word, 0 from told union all select path.word, told.form, depth + 1 from path join told on told.word = at_ where told.form is not null),
roots as (select word, arg_max(at_, depth) as root from path group by word)
select word, form, root, n, n_near, form_n from told join roots using (word)"""

#: Draws from the id's checksum, cuts by code points, and the text put together again from prefix, middle and suffix.
OP12 = r"""
with t as (select doc_id, coalesce(text, '') as x, length(coalesce(text, ''))::bigint as n, sha256('1:' || doc_id) as s from documents),
h as (select *, ('0x' || s[1:8])::bigint % (n + 1) as a, ('0x' || s[9:16])::bigint % (n + 1) as b, ('0x' || s[17:24])::bigint % 100 as c, ('0x' || s[25:32])::bigint % 100 as d from t),
f as (select *, least(a, b) as k, greatest(a, b) as m, case when x = '' or contains(x, '<P>') or contains(x, '<S>') or contains(x, '<M>') or c >= 90 then 'plain' when d < 20 then 'spm' else 'psm' end as form from h),
p as (select *, substring(x, 1, k) as pre, substring(x, k + 1, m - k) as mid, substring(x, m + 1) as suf from f)
select doc_id, n, form, case when form <> 'plain' then k end as prefix_chars, case when form <> 'plain' then m - k end as middle_chars,
sha256(case form when 'plain' then x when 'psm' then '<P>' || pre || '<S>' || suf || '<M>' || mid else '<S>' || suf || '<P>' || pre || '<M>' || mid end) as output_sha256,
sha256(case form when 'plain' then x else pre || mid || suf end) as restored_sha256 from p"""

#: Windows of words as texts, the first document of each, and the words that those of later documents cover.
OP13 = r"""
with d as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
p as (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13),
w as (select doc_id, i, array_to_string(ws[i:i + 12], ' ') as g from p),
f as (select doc_id, i from (select *, min(doc_id) over (partition by g) as m from w) where m < doc_id),
gone as (select distinct doc_id, unnest(range(i, i + 13)) as k from f),
g as (select doc_id, list(k) as ks from gone group by doc_id),
k as (select doc_id, ws, coalesce(ks, []) as ks from d left join g using (doc_id)),
x as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as k from d),
left_ as (select doc_id, string_agg(word, ' ' order by k) as t from x anti join gone using (doc_id, k) group by doc_id)
select doc_id, len(ws)::bigint as n_words, len(ks)::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from k left join left_ using (doc_id)"""

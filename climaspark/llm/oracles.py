"""DuckDB SQL for the queries that it can express: by plain definitions, not by the operators' methods."""

# Conversations: text kept by turns, escapes counted.
CHAT = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(regexp_replace(text, '([\\\[\]<])', '\\\1', 'g')) as n, length(regexp_replace(role, '([\\\[\]<])', '\\\1', 'g')) as m from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(case when role = 'assistant' then n + 7 else n + m + 14 end) as bigint) as formatted_chars
from e group by conv_id"""

# Mixing: the Poisson distribution function by its terms; uniform numbers from MD5.
MIX = r"""
with sized as (select coalesce(source, '') as s, source is null as z, sum(coalesce(length(text), 0) + 1) as size from documents group by all),
r as (select s, z, cast((sum(size) over ()) as double) / (count(*) over () * size) as rate from sized),
p as (select s, z, greatest(1, cast(ceil(rate / 16) as int)) as parts, rate from r),
c as (select s, z, parts, k, sum(exp(-rate / parts + k * ln(rate / parts) - lgamma(k + 1))) over (partition by s, z order by k) as cdf from p, (select unnest(range(0, 81)) as k)),
u as (select d.*, part, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || part || ':17'), 1, 13)) as bigint) / 4503599627370496.0::double as u, p.s, p.z
  from documents d join p on p.s = coalesce(source, '') and p.z = (source is null), unnest(range(1, p.parts + 1)) as x(part)),
n as (select doc_id, text, lang, source, n_chars, sum(k) as n from (select u.doc_id, u.text, u.lang, u.source, u.n_chars, part, count(c.k) as k from u left join c on c.s = u.s and c.z = u.z and c.cdf <= u.u group by all) group by all)
select doc_id, text, lang, source, n_chars, cast(i as int) as copy, cast(('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || ':' || i || ':order:17'), 1, 13)) as bigint) as shuffle_key
from n, unnest(range(1, cast(n as bigint) + 1)) as x(i)"""

# Archives: base32 of the digest's forty hexadecimal digits, five at a time.
WARC = r"""
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, html, sha1(html) as d, max(page_id) over (partition by html) as last from p),
b as (select page_id, html, last, string_agg(c, '' order by i, j) as digest from
 (select page_id, html, last, i, j, substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((cast(('0x' || substr(d, i * 5 + 1, 5)) as bigint) >> (15 - 5 * j)) & 31), 1) as c from h, (select unnest(range(8)) as i), (select unnest(range(4)) as j)) group by page_id, html, last)
select page_id, cast(strlen(html) as bigint) as payload_bytes, digest as payload_digest, case when page_id = last then 'response' else 'revisit' end as record_type, case when page_id <> last then last end as refers_to from b"""

# Near copies: all shared shingles joined, then components by repeated closure.
JACCARD = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) >= 5 then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) when len(words) > 0 then [array_to_string(words, ' ') || '|'] else [] end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as x, b.doc_id as y from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id join n p on p.doc_id = a.doc_id join n q on q.doc_id = b.doc_id group by a.doc_id, b.doc_id, p.n, q.n having count(*) >= 0.8 * (p.n + q.n - count(*)) - 1e-6
  union select a.doc_id, b.doc_id from w a join w b on len(a.words) = 0 and len(b.words) = 0 and a.doc_id <> b.doc_id),
reach as (select doc_id as x, doc_id as y from w union select r.x, l.y from reach r join links l on l.x = r.y)
select w.doc_id, c.class_id, coalesce(l.n, 0) as n_links, count(*) over (partition by words) as copies from w join (select x, min(y) as class_id from reach group by x) c on c.x = w.doc_id left join (select x, count(*) as n from links group by x) l on l.x = w.doc_id"""

# Collocations: all phrases of one to five words counted, every cut of each, wide integers.
COLLOCATIONS = r"""
with p as (select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
g as (select lang, k, array_to_string(words[i : i + k - 1], ' ') as phrase from w, unnest([1, 2, 3, 4, 5]) as u(k), unnest(range(1, len(words) - k + 2)) as v(i)),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as words from f where k > 1 and f >= 100),
s as (select c.lang, c.k, c.phrase, a, cut, l.f as l, r.f as r, n.n, 1000::hugeint * a * n.n // (l.f::hugeint * r.f) as score from c, unnest(range(1, c.k)) as u(cut)
  join f l on l.lang = c.lang and l.phrase = array_to_string(words[:cut], ' ') join f r on r.lang = c.lang and r.phrase = array_to_string(words[cut + 1:], ' ') join n on n.lang = c.lang),
b as (select *, row_number() over (partition by lang, phrase order by score, cut) as i from s),
x as (select lang, array_to_string(words[:k - 1], ' ') as part, a from c union all select lang, array_to_string(words[2:], ' '), a from c),
k as (select * from b where i = 1 and not exists (select 1 from x where x.lang = b.lang and x.part = b.phrase and 100 * x.a >= 100 * b.a))
select lang, rank, phrase, a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from k) where rank <= 2000"""

# Near vectors: all pairs of a label measured, then components by repeated closure.
VECTORS = r"""
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and list_bool_and(list_transform(embedding, lambda c: c is not null and isfinite(c))) and list_bool_or(list_transform(embedding, lambda c: c <> 0))),
links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e) where list_cosine_similarity(a.e, b.e) >= 0.93),
reach as (select x, y from links union select r.x, l.y from reach r join links l on l.x = r.y)
select e.vec_id, coalesce(n, 0) as n_links, least(e.vec_id, coalesce(m, e.vec_id)) as component_id, e.vec_id = least(e.vec_id, coalesce(m, e.vec_id)) as kept
from embeddings e left join (select x, count(*) as n from links group by x) l on l.x = e.vec_id left join (select x, min(y) as m from reach group by x) r on r.x = e.vec_id"""

MIXED = CHAT.replace("""
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'""", "")

ORACLES = {"op5_chat_formatting": CHAT, "chat_mixed_layouts": MIXED, "op6_poisson_mixing": MIX, "op8_warc": WARC, "op10_jaccard_join": JACCARD, "op11_collocations": COLLOCATIONS, "op12_vector_dedup": VECTORS}

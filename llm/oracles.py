"""DuckDB SQL with the rows of those queries that SQL can express.

The SQL of op1 has no link edges, as the given pages hold none; components are tested on planted edges.
"""

from __future__ import annotations

from llm.quality import MAX_LOST_PERCENT, MAX_REPEAT_PERCENT, MIN_WORDS, NOTICES
from llm.url_filters import RULES

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEXT = "coalesce(text, '')"
_SPACED = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

_rules = ", ".join(f"('{a}', '{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}')" for a, r in RULES)
OP1 = rf"""with p as (select page_id, {_LOW.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) as path from pages),
r as (select * from (values {_rules}) as v(action, rule, suffix, prefix)),
best as (select host, path, rule, action from (select distinct host, path from p) d join r on (host = suffix or ends_with(host, '.' || suffix)) and starts_with(path, prefix)
  qualify row_number() over (partition by host, path order by length(rule) desc, length(suffix) desc, action) = 1)
select page_id, p.host, p.path, rule, coalesce(action, 'allow') as verdict, case when action is null then 'default' else 'rule' end as reason
from p left join best b on b.host = p.host and b.path = p.path"""

OP3 = rf"""with iw as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all({_LOW.format(_TEXT)}, {_ALNUM}) as w from benchmark),
win as (select distinct item, least(10, len(w)) as m, w[s:s + least(10, len(w)) - 1] as x from iw, unnest(range(1, len(w) - least(10, len(w)) + 2)) as t(s) where len(w) > 0),
dw as (select row_number() over () as row, doc_id, regexp_extract_all({_LOW.format(_TEXT)}, {_ALNUM}) as w from documents),
pos as (select row, s, m, w[s:s + m - 1] as x from dw, (select distinct m from win) as z, unnest(range(1, cast(len(w) - m + 2 as bigint))) as t(s) where len(w) >= m),
hit as (select row, s, pos.m, item from pos join win on win.x = pos.x and win.m = pos.m),
cov as (select row, count(distinct q) as n from hit, unnest(range(s, s + m)) as t(q) group by row),
its as (select row, count(*) as n, string_agg(item, ',' order by item) as l from (select distinct row, item from hit) as z group by row)
select doc_id, len(w) as n_words, coalesce(cov.n, 0) as n_hit, coalesce(its.n, 0) as n_items, sha256(coalesce(its.l, '')) as items_sha256, cov.n is not null as contaminated
from dw left join cov on cov.row = dw.row left join its on its.row = dw.row"""

OP4 = rf"""with recursive d as (select doc_id, regexp_extract_all({_LOW.format(_TEXT)}, {_SPACED}) as w from documents),
s as (select distinct doc_id, case when len(w) < 5 then w else w[i:i + 4] end as x from d, unnest(range(1, greatest(2, len(w) - 3))) as t(i) where len(w) > 0),
n as (select doc_id, count(*) as n from s group by doc_id),
l as (select a.doc_id as a, b.doc_id as b from s as a join s as b on a.x = b.x and a.doc_id <> b.doc_id join n as na on na.doc_id = a.doc_id join n as nb on nb.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, na.n, nb.n having 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b)
select d.doc_id, coalesce(n.n, 0) as n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) as component_id
from d left join n on n.doc_id = d.doc_id left join (select a, min(b) as m from r group by a) as c on c.a = d.doc_id"""

_ESC = r"regexp_replace({}, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g')"
OP8 = rf"""with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(20 + length({_ESC.format('role')}) + length({_ESC.format('text')})) as bigint) as formatted_chars
from t group by conv_id"""

_chars = r"length(regexp_replace({}, '[\x20\x09-\x0D]+', '', 'g'))"
_count = "length({0}) - length(regexp_replace({0}, '{1}', '', 'g'))"
OP10 = rf"""with d as (select row_number() over () as row, doc_id, {_TEXT} as text, regexp_extract_all({_TEXT}, {_SPACED}) as w from documents),
g as (select row, i, w[i:i + 7] as x from d, unnest(range(1, len(w) - 6)) as t(i)),
cov as (select row, count(distinct q) as n from (select row, i from g qualify count(*) over (partition by row, x) > 1) as z, unnest(range(i, i + 8)) as t(q) group by row),
li as (select row, x from d, unnest(string_split(text, chr(10))) as t(x) where regexp_matches(x, '[^\x20\x09-\x0D]')),
one as (select distinct row, x, {_chars.format('x')} as chars, regexp_extract_all(x, {_SPACED}) as w, {_count.format('x', r'\p{Lu}')} as up, {_count.format('x', r'\p{Ll}')} as low,
  {_count.format('x', '[#*$%&|<>]')} as sym, len(regexp_extract_all(regexp_replace(x, '(\s)', '\1\1', 'g'), '(?:^|\s)[|»›•·/](?:\s|$)')) as nav from li),
ok as (select row, sum(chars) as kept from one where not (sym * 100 > chars * 10 or nav * 100 > len(w) * 15 or (len(w) >= 5 and regexp_matches(x, '\p{{Lu}}\p{{Lu}}') and up * 100 > (up + low) * 70)
  or (len(w) >= 8 and not regexp_matches(x, '[\p{{L}}\p{{N}}][.!?…:;]["''”’»)\]]*(?:\s|$)|[。！？]'))
  or (len(w) <= 12 and regexp_matches(lower(x), '\b(?:{"|".join(NOTICES)})\b')) or (len(w) >= 10 and len(list_distinct(w)) * 100 < len(w) * 35)) group by row),
b as (select d.row, doc_id, len(w) as n_words, {_chars.format('text')} as word_chars, {_count.format('text', '[#*$%&|<>]')} as n_symbols,
  coalesce(l.n, 0) as n_dup_lines, coalesce(cov.n, 0) as n_repeat_words, coalesce(ok.kept, 0) as kept_chars
  from d left join cov on cov.row = d.row left join ok on ok.row = d.row left join (select row, count(*) - count(distinct x) as n from li group by row) as l on l.row = d.row)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words as base_failed,
 word_chars - kept_chars as lost_chars, not (n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)
 and 100 * (word_chars - kept_chars) <= {MAX_LOST_PERCENT} * word_chars as kept from b"""

def _lloyd(rounds: int = 4, parts: int = 4, entries: int = 256) -> str:
    """A chain of tables: the codebook of each round, the parts' nearest entries, their floored means."""
    steps = [rf"""e as materialized (select row_number() over () as row, vec_id, label, list_transform(embedding, lambda x: floor(1024 * cast(x as double))) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)""",
        f"p as materialized (select row, part, v[len(v) // {parts} * part + 1:len(v) // {parts} * (part + 1)] as x from e, unnest(range({parts})) as t(part))",
        f"""cb0 as materialized (select part, k as entry, x from p join (select row, row_number() over (order by vec_id nulls last, v) - 1 as k from e) as f
  on f.row = p.row where k < {entries})"""]
    square = "list_inner_product(p.x, p.x) - 2 * list_inner_product(p.x, c.x) + list_inner_product(c.x, c.x)"
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select row, p.part, min(struct_pack(d := {square}, entry := entry)) as m, any_value(p.x) as x
  from p join cb{r} as c on c.part = p.part group by row, p.part)""")
        if r < rounds:
            steps.append(f"""cb{r + 1} as materialized (select c.part, c.entry, coalesce(n.x, c.x) as x from cb{r} as c left join
  (select part, entry, list(y order by j) as x from (select part, m.entry as entry, j, floor(sum(x[j]) / count(*)) as y
    from a{r}, unnest(range(1, len(x) + 1)) as t(j) group by part, m.entry, j) as z group by part, entry) as n on n.part = c.part and n.entry = c.entry)""")
    last = f"a{rounds}"
    return f"""with {", ".join(steps)},
o as (select row, string_agg(printf('%02x', m.entry), '' order by part) as code, cast(sum(m.d) as bigint) as error from {last} group by row),
b as (select sha256(string_agg(cast(cast(y as bigint) as varchar), ',' order by part, entry, j)) as s from (select part, entry, j, x[j] as y from cb{rounds}, unnest(range(1, len(x) + 1)) as t(j)) as z)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, s as codebooks_sha256 from o join e on e.row = o.row cross join b"""


OP11 = _lloyd()


def _byte_steps() -> list[int]:
    """The step of each byte of a CRC-32 register, by its rule."""
    out = []
    for x in range(256):
        for _ in range(8):
            x = x >> 1 ^ 0xEDB88320 * (x & 1)
        out.append(x)
    return out


_crc = "list_reduce(list_transform(range(1, len(h) // 2 + 1), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i]) - 1), lambda c, y: xor(c >> 8, steps[xor(c & 255, y) + 1]), cast(4294967295 as bigint))"
OP12 = rf"""with k as (select cast({_byte_steps()} as bigint[]) as steps),
d as materialized (select row_number() over () as row, doc_id, regexp_extract_all({_LOW.format(_TEXT)}, {_ALNUM}) as w from documents),
dw as materialized (select row, unnest(w) as w from d), bw as materialized (select unnest(regexp_extract_all({_LOW.format(_TEXT)}, {_ALNUM})) as w from benchmark),
v as materialized (select w, xor({_crc}, 4294967295) % 10000 as b from (select distinct w, upper(hex(encode(w))) as h from (select w from dw union all select w from bw) as z) as y, k),
s as (select b, count(*) as n from dw join v using (w) group by b), t as (select b, count(*) as n from bw join v using (w) group by b),
g as materialized (select s.b, cast(floor(1000 * ln(cast(coalesce(t.n, 0) + 1 as double) * ((select sum(n) from s) + 10000)
  / (cast(s.n + 1 as double) * (coalesce((select sum(n) from t), 0) + 10000)))) as bigint) as gain from s left join t on t.b = s.b),
x as (select d.row, doc_id, len(w) as n, coalesce(q.weight, 0) as weight from d left join (select row, sum(gain) as weight from dw join v using (w) join g using (b) group by row) as q on q.row = d.row),
y as (select *, upper(sha256('2024:' || coalesce(cast(doc_id as varchar), '')))[1:8] as h from x),
z as (select *, weight + floor(-1000 * ln(-ln((list_reduce(list_transform(range(1, 9), lambda i: cast(strpos('0123456789ABCDEF', h[i]) - 1 as bigint)), lambda a, c: a * 16 + c) + 0.5::double) / 4294967296::double))) as score from y),
r as (select row, row_number() over (order by score desc, doc_id nulls first) as rank, count(*) over () as m from z where n >= 20)
select doc_id, cast(n as bigint) as n_features, cast(weight as bigint) as weight, cast(score as bigint) as score, case when rank <= 10 * m // 100 then rank end as rank
from z left join r on r.row = z.row"""

ORACLES = {
    "op1_url_filters": OP1, "op3_benchmark_decontamination": OP3, "op4_ngram_jaccard_join": OP4, "op8_chat_formatting": OP8,
    "op10_quality_rules": OP10, "op11_cover_tree_codes": OP11, "op12_importance_resampling": OP12,
}

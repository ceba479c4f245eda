"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

from threadloom.llm.chat import LEARNED_ROLE
from threadloom.llm import urls
from threadloom.llm.secrets import RULES

_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x20\x09-\x0D]+')"
_LOWERED = "translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SUBSTRINGS = f"""
with w as (select doc_id, {_WORDS.format(text="text")} as ws from documents),
starts as (select doc_id, ws, unnest(generate_series(1, len(ws) - 49)) as i from w where len(ws) >= 50),
windows as (select doc_id, i, md5(array_to_string(ws[i:i+49], ' ')) as win from starts),
firsts as (select win, min(doc_id) as least from windows group by win),
gone as (select distinct doc_id, unnest(generate_series(i, i + 49)) as p
         from windows join firsts using (win) where least < doc_id),
each as (select doc_id, unnest(ws) as word, unnest(generate_series(1, len(ws))) as p from w),
kept as (select doc_id, string_agg(word, ' ' order by p) as kept
         from each anti join gone using (doc_id, p) group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n, 0) as n_removed,
       sha256(coalesce(kept, '')) as kept_sha256
from w left join kept using (doc_id)
left join (select doc_id, count(*) as n from gone group by doc_id) g using (doc_id)
"""

NEAR_DUPLICATES = f"""
with recursive w as (select doc_id, {_WORDS.format(text=_LOWERED.format(text="text"))} as ws from documents),
pieces as (select doc_id, unnest(case when len(ws) >= 3
               then list_transform(generate_series(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+2], ' '))
               when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as shingle from w),
sets as (select distinct doc_id, shingle from pieces),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
shared as (select a.doc_id as a, b.doc_id as b, count(*) as n
           from sets a join sets b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from shared s join sizes x on x.doc_id = a join sizes y on y.doc_id = b
          where 100 * s.n >= 85 * (x.n + y.n - s.n)),
both_ways as (select a, b from links union select b, a from links),
reached as (select a, b from both_ways union select r.a, l.b from reached r join both_ways l on l.a = r.b),
least as (select a as doc_id, min(b) as other from reached group by a)
select doc_id, coalesce(n, 0) as n_shingles, least(doc_id, coalesce(other, doc_id)) as component_id,
       doc_id = least(doc_id, coalesce(other, doc_id)) as kept
from w left join sizes using (doc_id) left join least using (doc_id)
"""

_BENCHMARK_WORDS = r"regexp_extract_all(coalesce({text}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
with w as (select doc_id, {_BENCHMARK_WORDS.format(text=_LOWERED.format(text="text"))} as ws from documents),
items as (select item_id, {_BENCHMARK_WORDS.format(text=_LOWERED.format(text="text"))} as ws from benchmark),
item_starts as (select item_id, ws, least(10, len(ws)) as n, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) as i
                from items where len(ws) > 0),
wanted as (select distinct item_id, n, array_to_string(ws[i:i+n-1], ' ') as win from item_starts),
starts as (select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as i
           from w, (select distinct n from wanted) l where len(ws) >= n),
windows as (select doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') as win from starts),
found as (select doc_id, n, i, win from windows semi join wanted using (n, win)),
hit as (select distinct doc_id, unnest(generate_series(i, i + n - 1)) as p from found),
hits as (select doc_id, count(*) as n_hit from hit group by doc_id),
named as (select distinct doc_id, cast(item_id as varchar) as item from found join wanted using (n, win)),
listed as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from named group by doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from w left join hits using (doc_id) left join listed using (doc_id)
"""

NEAREST = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
scored as (select q.vec_id as query_id, c.vec_id as vec_id, list_dot_product(q.e, c.e) as score
           from v q join v c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored)
select query_id, cast(rank as integer) as rank, vec_id, score from ranked where rank <= 20
"""

_MARK = r"(<\\*/?s>)|(\[\\*/?INST\])"
_ESCAPED = "length({c}) + len(regexp_extract_all({c}, '" + _MARK + "'))"

CHAT = f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select * from (values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')) s)
select conv_id, count(*) as n_turns,
       sha256(string_agg(concat(role, chr(10), text, chr(10)), '' order by turn)) as turns_sha256,
       cast(coalesce(sum(length(text)) filter (role = '{LEARNED_ROLE}'), 0) as bigint) as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (role = '{LEARNED_ROLE}'), '')) as loss_sha256,
       cast(sum(16 + {_ESCAPED.format(c="role")} + {_ESCAPED.format(c="text")}) as bigint) as formatted_chars
from t group by conv_id
"""


def _kind(place: int, pattern: str, group: int, least: int, kind: str) -> str:
    pattern = pattern.replace("'", "''")
    return f"""select doc_id, {place} as place, '{kind}' as kind, length(m) as size,
       length(g) >= {least} as counts, i, list_sum(list_transform(parts[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) as start
from (select doc_id, parts, ms, unnest(ms) as m, unnest(gs) as g, unnest(generate_series(1, len(ms))) as i
      from (select doc_id, string_split_regex(t, '{pattern}') as parts, regexp_extract_all(t, '{pattern}', 0) as ms,
                   regexp_extract_all(t, '{pattern}', {group}) as gs from d) a) b"""


_KINDS = [_kind(n, r.pattern, r.group, r.least, r.kind) for n, r in enumerate(RULES)]
_LIST = "string_agg(concat(kind, ':', start, ':', start + size), ',' order by start, place)"

SECRETS = f"""
with d as (select doc_id, coalesce(text, '') as t from documents),
found as (select * from ({" union all ".join(_KINDS)}) f where counts),
by_doc as (select doc_id, count(*) filter (place = 0) as a, count(*) filter (place = 1) as b, count(*) filter (place = 2) as c,
                  {_LIST} filter (place <= 2) as base, {_LIST} as spans from found group by doc_id)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from d left join by_doc using (doc_id)
"""


def _rule_case(result: str) -> str:
    """A case over the url rules, longest first; ``result`` names what a rule gives."""
    arms = "".join(
        f" when (host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
        f" then '{getattr(r, result)}'"
        for r in sorted(urls.RULES, key=lambda r: (-len(r.text), r.text))
    )
    return f"case{arms} end"


def _form_sql(segment: str) -> str:
    return (
        f"case when {segment} is null then 'end' when regexp_matches({segment}, '^[0-9]+(\\.[a-z]+)?$') then 'number'"
        f" when regexp_matches({segment}, '[0-9]') then 'mixed' else 'word' end"
    )


def _difference_sql(one: str, other: str) -> str:
    """The G statistic of two sets of counts, in millionths."""

    def log_sum(counts: list[str]) -> str:
        total = " + ".join(counts)
        terms = [f"case when {x} > 0 then ({x})::double * ln(({x})::double) else 0e0 end" for x in (*counts, total)]
        return f"({' + '.join(terms[:-1])} - {terms[-1]})"

    parts = []
    for table in (["n_end", "n_number", "n_mixed", "n_word"], ["bad", "good"]):
        a, b = [f"{one}.{c}" for c in table], [f"{other}.{c}" for c in table]
        parts.append(f"{log_sum(a)} + {log_sum(b)} - {log_sum([f'({x} + {y})' for x, y in zip(a, b)])}")
    return f"cast(round(({parts[0]} + {parts[1]}) * 2e6) as bigint)"


def _level_sql(n: int) -> str:
    """The views that add segment ``n + 1`` to every template."""
    here, below = f"segments[{n + 1}]", f"segments[{n + 2}]"
    hexed = f"regexp_replace({here}, '[0-9a-f]{{8,}}(-[0-9a-f]{{4,}})*', '{{h}}', 'g')"
    forms = ("end", "number", "mixed", "word")
    counts = ", ".join(f"count(*) filter (below = '{f}') as n_{f}" for f in forms)
    shares = ", ".join(f"cast(round(n_{f} * 4e0 / paths) as integer)" for f in forms)
    sums = ", ".join(f"cast(sum({c}) as bigint) as {c}" for c in ("n_end", "n_number", "n_mixed", "n_word", "bad", "good"))
    pool = ", ".join(f"'{c}': {c}" for c in ("least", "alike", "rejects", "n_end", "n_number", "n_mixed", "n_word", "bad", "good"))
    return f"""
rows{n} as (select *, case when {here} is null then ''
                 when regexp_matches({here}, '[0-9]') then regexp_replace({hexed}, '[0-9]+', '{{n}}', 'g') else {here} end as child,
                 {_form_sql(below)} as below from state{n}),
branches{n} as (select host, prefix, child, count(*) as paths, sum(bad) as bad, sum(good) as good, {counts}
                from rows{n} group by host, prefix, child),
parents{n} as (select host, prefix, count(*) as children, sum(paths) as under from branches{n} where child <> '' group by host, prefix),
nodes{n} as (select b.*, (bad + {urls.PRIOR * urls.PRIOR_WEIGHT}e0) / (bad + good + {urls.PRIOR_WEIGHT}e0) > {urls.LIMIT}e0 as rejects,
                     coalesce(children >= {urls.WILD_CHILDREN} and children * 2 >= under, false) as wild
             from branches{n} b left join parents{n} using (host, prefix)),
profiled{n} as (select *, case when not wild and paths >= {urls.MERGE_PATHS} and child <> ''
                               then concat_ws(',', {shares}, cast(floor((bad + 1) * 3e0 / (bad + good + 2)) as integer), rejects::integer) end as alike
                from nodes{n}),
pools{n} as (select host, prefix, alike, rejects, cast(-sum(paths) as bigint) as least, {sums} from profiled{n} where alike is not null group by host, prefix, alike, rejects),
leaders{n} as (select host, prefix, list_reduce(list([{{{pool}}}] order by least, alike),
                      lambda known, e: case when len(list_filter(known, lambda x: x.rejects = e[1].rejects and {_difference_sql("x", "e[1]")} <= {urls.DIFFERENT})) > 0
                                            then known else list_concat(known, e) end) as leaders
               from pools{n} group by host, prefix),
measured{n} as (select p.host, p.prefix, p.child, {_difference_sql("x", "p")} as g, x.least as least, x.alike as lead
                from profiled{n} p join (select host, prefix, unnest(leaders) as x from leaders{n}) l using (host, prefix)
                where p.alike is not null and p.rejects = x.rejects),
led{n} as (select host, prefix, child, arg_min(lead, (g, least, lead)) as lead from measured{n}
           where g <= {urls.DIFFERENT} group by host, prefix, child),
merged{n} as (select host, prefix, lead, min(child) as least from led{n} group by 1, 2, 3),
names{n} as (select p.host, p.prefix, p.child,
                    case when child = '' then '' when wild then '/*' else concat('/', coalesce(least, child)) end as name
             from profiled{n} p left join led{n} using (host, prefix, child) left join merged{n} using (host, prefix, lead)),
state{n + 1} as (select host, path, ruled, bad, good, segments, concat(prefix, name) as prefix
                 from rows{n} join names{n} using (host, prefix, child))"""


URLS = f"""
with rest as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (select page_id, {_LOWERED.format(text="regexp_extract(rest, '^([^/?#]*)', 1)")} as host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
judged as (select *, {_rule_case("text")} as rule, {_rule_case("verdict")} as ruled from split),
state0 as (select host, path, any_value(ruled) as ruled, count(*) filter (ruled = 'block') as bad,
                  count(*) filter (ruled = 'allow') as good,
                  list_filter(string_split(path, '/'), lambda s: s <> '') as segments, '' as prefix
           from judged group by host, path),
{",".join(_level_sql(n) for n in range(urls.DEPTH))},
known as (select *, concat(prefix, case when len(segments) > {urls.DEPTH} then '/**' else '' end) as template from state{urls.DEPTH}),
leaves as (select host, template,
                  (sum(bad) + {urls.PRIOR * urls.PRIOR_WEIGHT}e0) / (sum(bad) + sum(good) + {urls.PRIOR_WEIGHT}e0) > {urls.LIMIT}e0 as rejected
           from known group by host, template)
select page_id, host, path, rule, coalesce(j.ruled, case when rejected then 'block' else 'allow' end) as verdict, template
from judged j join known k using (host, path) join leaves using (host, template)
"""


#: One byte of the checksum that zip files use, by its polynomial with reversed bits.
_CRC_STEP = "case when {c} & 1 = 1 then xor({c} >> 1, 3988292384) else {c} >> 1 end"
_UTF8 = (
    "flatten(list_transform(string_split({text}, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint]"
    " else [(192 | (unicode(x) >> 6))::bigint, (128 | (unicode(x) & 63))::bigint] end))"
)

SPELLING = f"""
with recursive bits as (select n, 0 as step, n::bigint as c from range(256) r(n)
              union all select n, step + 1, {_CRC_STEP.format(c="c")} from bits where step < 8),
crcs as (select list(c order by n) as crc from bits where step = 8),
runs as (select doc_id, unnest(regexp_extract_all({_LOWERED.format(text="coalesce(text, '')")}, '[A-Za-z\u00C0-\u00FF]+')) as run from documents),
counted as (select coalesce(cast(doc_id as varchar), 'null') as doc, run, count(*) as n from runs group by all),
hashed as (select run, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, {_UTF8.format(text="concat(doc, ':', run)")}),
               lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]))) as h from counted, crcs),
slipped as (select case when h % 97 = 0 then concat(run[1:h % length(run)], run[h % length(run) + 2:]) else run end as word, n from hashed),
words as (select word, cast(sum(n) as bigint) as n from slipped where length(word) >= 5 group by word having sum(n) >= 3),
gaps as (select word, n, i, concat(word[1:i-1], word[i+1:]) as rest from words, lateral (select unnest(generate_series(1, length(word))) as i)),
replaced as (select a.word as a, b.word as b from gaps a join gaps b on a.i = b.i and a.rest = b.rest and a.word <> b.word),
inserted as (select distinct g.word as a, w.word as b from gaps g join words w on g.rest = w.word),
near as (select a, b from replaced union select a, b from inserted union select b, a from inserted),
best as (select a as word, count(*) as n_near, arg_min(b, (-n, b)) as best, max(n) as best_n
         from near join words on words.word = b group by a),
judged as (select word, words.n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form,
                  case when best_n >= 2 * n then best_n end as form_n from words left join best using (word)),
led as (select word, word as root, form as next from judged
        union all select led.word, led.next, judged.form from led join judged on judged.word = led.next),
last as (select word, root from led where next is null)
select word, form, root, n, n_near, form_n from judged join last using (word)
"""

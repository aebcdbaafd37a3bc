"""The SQL side of the core queries, for DuckDB, built from shared parts."""

from __future__ import annotations

import re

THRESHOLD = 0.25
#: English function words, written out here so that this side does not lean on the library's.
FUNCTION_WORDS = """
'd 'll 'm 're 's 've -lcb- -lrb- -lsb- -rcb- -rrb- -rsb- a about above across after again against all along also although am among an and another any
are around as at be because been before behind being below beneath beside between beyond both but by can cannot could despite did do does doing done
down during each either ever every except for from had half has have having he her here hers herself him himself his how i if in inside into is it its
itself just like may me might mine must my myself n't near neither never no nor not of off on once one only onto or other ought our ours ourselves out
outside over past per shall she should since so some such than that the their theirs them themselves then there these they this those though through
throughout to too toward towards under unless until up upon us very via was we were what when where whereas whether which while who whom whose why
will with within without would yet you your yours yourself yourselves
"""
#: Simple classes of Penn tags.
SIMPLE_TAGS = (("JJ", "JJ JJR JJS"), ("RB", "RB RBR RBS"), ("NN", "NN NNS NNP NNPS"), ("CD", "CD"), ("VB", "VB VBD VBG VBN VBP VBZ"))
_WORDS = ", ".join("'" + w.replace("'", "''") + "'" for w in FUNCTION_WORDS.split())
_PUNCTUATION = r"'[!-/:-@\[-`{-~]+'"
_SPLIT = r"'[ \t\n\r\f,.:;?!{}()\[\]'']+'"


def content(x: str) -> str:
    return f"({x} <> '' and not regexp_full_match({x}, {_PUNCTUATION}) and lower({x}) not in ({_WORDS}))"


def h(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 7))::bigint"


def words_of(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {_SPLIT}), lambda x: x <> '')"


#: Shared parts by name, each with the parts it needs.
PARTS: dict[str, tuple[str, str]] = {
    "tok": ("", "select text_id as doc_id, sent_id, tok_idx as i, coalesce(wf, '') as form, coalesce(nullif(lemma, ''), wf, '') as lemma, coalesce(pos, 'X') as pos from (select distinct tok_id, text_id, sent_id, tok_idx, wf, lemma, pos from tokens where tok_id is not null and text_id is not null)"),
    "nref": ("", "select count(*) as v from embeddings"),
    "mean": ("", "select vec_id as ref, label < 2 as is_ne, (['Location', 'Organization', 'Person', 'Other'])[label % 4 + 1] as type, embedding::double[] as vec from embeddings"),
    "sent": ("tok", "select doc_id, sent_id, list({'form': form, 'lemma': lemma, 'pos': pos} order by i) as t from tok group by all"),
    "ctok": ("tok", f"select doc_id, form, count(*) as n from tok where {content('form')} group by all having count(*) >= 2"),
    "wrd": ("tok", f"select *, format('{{}}_{{:03d}}-{{:03d}}', sent_id, i, i + 1) as mention_id from tok where {content('form')} and pos <> 'X'"),
    "keys": ("wrd", "select lemma as key from wrd union select form from wrd"),
    "dict": ("keys nref", f"select key, k + 1 as sense_rank, ({h('key')} + 37 * k) % v as ref from keys, nref, (select unnest(range(2)) as k)"),
    "pairs": ("wrd", "select distinct form, lemma from wrd"),
    "found": ("pairs dict", "select form, lemma, ref, min((p, sense_rank)) as place from (select form, lemma, lemma as key, 0 as p from pairs union all select form, lemma, form, 1 from pairs) join dict using (key) group by all"),
    "cand": ("found wrd", "select doc_id, mention_id, ref, ord from wrd join (select form, lemma, ref, row_number() over (partition by form, lemma order by place, ref) as ord from found) using (form, lemma)"),
    "wvec": ("tok nref mean", f"select item, vec from (select distinct form as item from tok) t, nref join mean on mean.ref = {h('item')} % v"),
    "ctx": ("ctok wvec", "select doc_id, list(x order by k) as vec from (select doc_id, k, avg(vec[k]) as x from ctok join wvec on form = item, (select unnest(range(1, 65)) as k) group by all) group by doc_id"),
    "raw": ("cand ctx mean", "select doc_id, ref, coalesce(list_cosine_similarity(ctx.vec, mean.vec), 0.0) as w from (select distinct doc_id, ref from cand) left join ctx using (doc_id) left join mean using (ref)"),
    "cw": ("raw", "select doc_id, ref, case when min(w) over (partition by doc_id) < 0 then (w + 1) / 2 else w end as w from raw"),
    "wc": ("cand cw", "select * from cand join cw using (doc_id, ref)"),
    "spn": ("sent", "select doc_id, sent_id, l::int as l, r::int as r, array_to_string(list_transform(s, lambda x: x.form), ' ') as form, array_to_string(list_transform(s, lambda x: x.lemma), ' ') as lemma, case when r - l > 1 then 'N' else s[1].pos end as pos from (select *, t[l + 1 : r] as s from (select *, unnest(range(l + 1, least(l + 3, len(t)) + 1)) as r from (select *, unnest(range(len(t))) as l from sent))) where case when r - l > 1 then len(list_filter(s, lambda x: starts_with(x.pos, 'N'))) > 0 else s[1].pos not in ('X', 'R') end"),
    "edg": ("wrd nref", f"select doc_id, src, dst, (['A0', 'A1', 'mod', 'loc'])[{h('(src::varchar || chr(95) || dst::varchar)')} % 4 + 1] as role from (select distinct doc_id, src, dst from (select doc_id, src, lead(src) over (partition by doc_id, sent_id order by i) as dst from (select doc_id, sent_id, i, {h('lemma')} % v as src from wrd, nref)) where dst is not null and src <> dst)"),
    "ver": ("edg", "select doc_id, v, sum(w)::double as w from (select doc_id, src as v, 1 as w from edg union all select doc_id, dst, 0 from edg) group by all"),
    "refs": ("cand cw mean", "select doc_id, ref, ms, w, vec from (select doc_id, ref, list(mention_id order by mention_id) as ms from cand group by all) join cw using (doc_id, ref) join mean using (ref)"),
    "ent": ("refs", f"select a.doc_id, a.ref as a, b.ref as b, case when a.ref = b.ref then 1.0 else list_cosine_similarity(a.vec, b.vec) end as value from refs a join refs b on a.doc_id = b.doc_id where a.ref = b.ref or (a.ms <> b.ms and list_cosine_similarity(a.vec, b.vec) >= {THRESHOLD})"),
    "tot": ("ent refs", "select doc_id, n, s / (n * n) as fill from (select doc_id, count(*) as n from refs group by all) join (select doc_id, sum(value) as s from ent group by all) using (doc_id)"),
    "rows": ("ent tot", "select doc_id, a, s + (n - c) * fill as rs, n - c as rest, fill from (select doc_id, a, sum(value) as s, count(*) as c from ent group by all) join tot using (doc_id)"),
    "bia": ("refs", "select doc_id, ref, case when sum(w) over p > 0 then w / sum(w) over p else 1.0 / count(*) over p end as l from refs window p as (partition by doc_id)"),
    "und": ("edg", "select doc_id, src as a, dst as b from edg union select doc_id, dst, src from edg"),
    "adj": ("und", "select doc_id, a, b, 1.0 / count(*) over (partition by doc_id, a) as value from und"),
    "vb": ("ver", "select doc_id, v, case when sum(s) over p > 0 then s / sum(s) over p else 1.0 / count(*) over p end as t from (select doc_id, v, w + avg(w) over (partition by doc_id) / 100 as s from ver) window p as (partition by doc_id)"),
    "ann": ("wrd nref", f"select doc_id, form, {h('lemma')} % v as ref from wrd, nref"),
    "gld": ("wrd nref", f"select doc_id, mention_id as key, ({h('lemma')} + 37 * ({h('form || chr(103)')} % 2)) % v as ref from wrd, nref"),
    "sys": ("cand", "select mention_id as key, ref from (select *, row_number() over (partition by doc_id, mention_id order by ord) as k from cand) where k = 1"),
    "smx": ("wc", "select *, exp(w) / sum(exp(w)) over (partition by doc_id, mention_id) as p from wc"),
    "lines": ("", r"""select distinct file_id, line_no, regexp_replace(line, '\s+$', '') as line, n from vector_lines left join (select distinct file_id, num_dimensions as n, vector_type from vector_files) using (file_id) where not (line_no = 1 and coalesce(vector_type = 'Text_Glove', false))"""),
    "quoted": ("lines", r"""select *, contains(coalesce(line, ''), '"') as quoted, regexp_matches(line, '^"([^"]|"")*"( [^"]*)?$') as right_quotes from lines"""),
    "cells": ("quoted", r"""select *, case when quoted then replace(regexp_extract(line, '^"(([^"]|"")*)"', 1), '""', '"') else string_split(line, ' ')[1] end as item, string_split(case when quoted then regexp_replace(line, '^"([^"]|"")*"', '') else line end, ' ')[2:] as numbers from quoted"""),
    "judged": ("cells", r"""select *, case when line is null or line = '' then 'columns' when quoted and not right_quotes then 'quoting' when n is null or len(numbers) <> n then 'columns'
      when item = '' or len(list_filter(numbers, lambda x: not (regexp_full_match(x, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') and isfinite(coalesce(try_cast(x as double), 'inf'::double))))) > 0 then 'value' end as reason from cells"""),
    "filevec": ("judged", "select file_id, item, arg_max(list_transform(numbers, lambda x: x::double), line_no) as vec from judged where reason is null group by all"),
}


def build(select: str, *parts: str) -> str:
    """A select over named parts, with all that they need before them."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for need in PARTS[name][0].split():
                add(need)
            order.append(name)

    for p in parts:
        add(p)
    return ("with " + ",\n".join(f"{p} as materialized ({PARTS[p][1]})" for p in order) + "\n" if order else "") + select


def variant(prefix: str, changed: dict[str, tuple[str, str]], *names: str) -> None:
    """Adds parts like ``names`` under a prefix, reading one another, with some of them changed."""
    pattern = re.compile(r"\b(" + "|".join(names) + r")\b(?!['\"(])")
    for name in names:
        needs, sql = changed[name] if name in changed else PARTS[name]
        PARTS[prefix + name] = (pattern.sub(prefix + r"\1", needs), pattern.sub(prefix + r"\1", sql))


def best(source: str, order: str, parts: str, where: str = "true") -> str:
    return build(f"select doc_id, mention_id, ref from (select *, row_number() over (partition by doc_id, mention_id order by {order}) as k from (select *, round(w, 9) as rw, max(round(w, 9)) over (partition by doc_id, mention_id) as top from {source}) where {where}) where k = 1", parts)


def iterate_meanings(steps: int, personalised: bool) -> str:
    """The unrolled iteration over stored entries; all other entries of a row are alike."""
    out = ["v0 as materialized (select doc_id, ref, 1.0 / count(*) over (partition by doc_id) as p from refs)"]
    b = "bt.l" if personalised else "null"
    for k in range(1, steps + 1):
        out.append(f"s{k} as materialized (select v.doc_id, sum(p) as total, sum(p * fill / rs) as base, sum(p * l) as lp from v{k - 1} v join rows on rows.doc_id = v.doc_id and rows.a = v.ref join bia on bia.doc_id = v.doc_id and bia.ref = v.ref group by all)")
        out.append(f"m{k} as materialized (select e.doc_id, e.b as ref, sum((e.value - fill) / rs * p) as x from ent e join v{k - 1} v on v.doc_id = e.doc_id and v.ref = e.a join rows on rows.doc_id = e.doc_id and rows.a = e.a group by all)")
        push = f"0.6 * {b} * total" if personalised else "0.6 * lp"
        out.append(f"u{k} as materialized (select bt.doc_id, bt.ref, {push} + 0.4 * (base + coalesce(x, 0)) as q from bia bt join s{k} using (doc_id) left join m{k} using (doc_id, ref))")
        out.append(f"v{k} as materialized (select doc_id, ref, q / sum(q) over (partition by doc_id) as p from u{k})")
    head = build("", "ent", "tot", "rows", "bia", "refs").rstrip()
    return head + ",\n" + ",\n".join(out) + f"\nselect doc_id, ref, round(p, 6) as rank from v{steps}"


def iterate_vertices(steps: int) -> str:
    out = ["v0 as materialized (select doc_id, v, 1.0 / count(*) over (partition by doc_id) as p from ver)"]
    for k in range(1, steps + 1):
        out.append(f"m{k} as materialized (select adj.doc_id, adj.b as v, sum(value * p) as x from adj join v{k - 1} r on r.doc_id = adj.doc_id and r.v = adj.a group by all)")
        out.append(f"u{k} as materialized (select vb.doc_id, vb.v, 0.2 * t + 0.8 * coalesce(x, 0) as q from vb left join m{k} using (doc_id, v))")
        out.append(f"v{k} as materialized (select doc_id, v, q / sum(q) over (partition by doc_id) as p from u{k})")
    return build("", "adj", "vb", "ver").rstrip() + ",\n" + ",\n".join(out) + f"\nselect doc_id, v, round(p, 6) as rank from v{steps}"


_SIMPLE = "case " + " ".join(f"when tag in ({', '.join(repr(t) for t in tags.split())}) then '{name}'" for name, tags in SIMPLE_TAGS) + " else 'FUNCTION' end"
_SIMILAR = "select a.vec_id as a, b.vec_id as b, round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 6) as c from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0"
_STATS = "round(min(x), 6) as least, round(max(x), 6) as most, round(avg(x), 6) as mean, round(median(x), 6) as median, round(stddev_samp(x), 6) as deviation"
_TFIDF = "select doc_id, ref, {tf} * ln(nd / (df + 1)) as x from (select doc_id, ref, count(*) as f from ann group by all) join (select ref, count(distinct doc_id) as df from ann group by all) using (ref), (select count(distinct doc_id)::double as nd from ann)"
_SCALED = "select doc_id, ref, case when max(x) over (partition by doc_id) <> 0 then x / max(x) over (partition by doc_id) else 0 end as w from ({x})"
_CONTRACT = "select doc_id, a as src, b as dst, min(role) as role from (select e.doc_id, coalesce(m.t, e.src) as a, coalesce(n.t, e.dst) as b, role from {e} e left join {m} m on m.doc_id = e.doc_id and m.v = e.src left join {m} n on n.doc_id = e.doc_id and n.v = e.dst) where a <> b group by all"


def nn(x: str) -> str:
    return f"(case when json_type({x}) = 'NULL' then null else {x} end)"


def listed(x: str) -> str:
    """The records that a JSON member stands for."""
    text = f"({x} ->> '$')"
    whole = f"case json_type({x}) when 'ARRAY' then cast({x} as json[]) when 'VARCHAR' then case when starts_with(trim({text}), '[') and json_valid({text}) then cast(cast({text} as json) as json[]) when trim({text}) = '' then [] else [{x}] end when 'NULL' then [] else case when {x} is null then [] else [{x}] end end"
    return f"list_filter({whole}, lambda e: e is not null and json_type(e) <> 'NULL')"


def member(record: str, *names: str) -> str:
    return "coalesce(" + ", ".join(nn(f"({record} -> '$.\"{n}\"')") for n in names) + ")"


def leaf(*names: str) -> str:
    return f"(case when json_type(r) = 'OBJECT' then {member('r', *names)} ->> '$' end)"


def below(source: str, keys: str, place: str, *names: str) -> str:
    return f"select {keys}, generate_subscripts(l, 1)::int - 1 as {place}, unnest(l) as r from (select {keys}, {listed(member('r', *names))} as l from {source} where json_type(r) = 'OBJECT')"


PARTS |= {
    "batch": ("", "select batch_id, any_value(texts) as texts, any_value(payload) as payload from corpus_batches where batch_id is not null group by all"),
    "doc": ("batch", "select batch_id, case when len(texts) > 0 then to_json({'texts': texts}) when json_valid(payload) then cast(payload as json) end as v from batch"),
    "val": ("doc", "select batch_id, case when json_type(v) = 'VARCHAR' and json_valid(v ->> '$') then cast(v ->> '$' as json) else v end as v from doc"),
    "root": ("val", f"select batch_id, case when json_type(v) = 'ARRAY' then {listed('v')} when json_type(v) <> 'OBJECT' then [] when {member('v', 'texts', 'text')} is not null then {listed(member('v', 'texts', 'text'))} else flatten(list_transform({listed(member('v', 'corpus'))}, lambda c: {listed(member('c', 'texts', 'text'))})) end as l from val where v is not null"),
    "tx": ("root", "select batch_id, generate_subscripts(l, 1)::int - 1 as text_no, unnest(l) as r from root"),
    "se": ("tx", below("tx", "batch_id, text_no", "sentence_no", "sentences", "sentence")),
    "tk": ("se", below("se", "batch_id, text_no, sentence_no", "token_no", "tokens", "wf")),
    "span2": ("sent", "select doc_id, sent_id, l::int as l, r::int as r, array_to_string(list_transform(s, lambda x: x.form), ' ') as form, array_to_string(list_transform(s, lambda x: x.lemma), ' ') as lemma from (select *, t[l + 1 : r] as s from (select *, unnest(range(l + 1, least(l + 2, len(t)) + 1)) as r from (select *, unnest(range(len(t))) as l from sent))) where case when r - l > 1 then len(list_filter(s, lambda x: starts_with(x.pos, 'N'))) > 0 else s[1].pos <> 'X' end"),
    "sifw": ("ctok", "select doc_id, form, 0.001 / (0.001 + count(*) over (partition by form) / count(*) over ()) as w from ctok"),
    "sifr": ("sifw wvec", "select doc_id, k, sum(w * vec[k]) / count(*) as x from sifw join wvec on form = item, (select unnest(range(1, 65)) as k) group by all"),
    "mom": ("sifr", "select a.k as i, b.k as j, sum(a.x * b.x) as m from sifr a join sifr b using (doc_id) group by all"),
    "known": ("ver mean", "select doc_id, v, w, is_ne, type from ver join mean on ref = v"),
}
#: Squarings of the moment matrix, after which it is the projection on its leading direction.
SQUARES = 16
for _k in range(SQUARES):
    _from = "mom" if _k == 0 else f"mom{_k}"
    PARTS[f"mom{_k + 1}"] = (_from, f"select i, j, m / sum(case when i = j then m end) over () as m from (select a.i, b.j, sum(a.m * b.m) as m from {_from} a join {_from} b on a.j = b.i group by all)")
variant(
    "m",
    {
        "wrd": ("span2", f"select doc_id, sent_id, form, lemma, format('{{}}_{{:03d}}-{{:03d}}', sent_id, l, r) as mention_id from span2 where {content('form')}"),
        "refs": ("top cw mean", "select doc_id, ref, ms, w, vec from (select doc_id, ref, list(mention_id order by mention_id) as ms from top group by all) join cw using (doc_id, ref) join mean using (ref)"),
        "top": ("wc", "select * from wc qualify row_number() over (partition by doc_id, mention_id order by ord) <= 1 or w >= 0.6"),
    },
    "wrd", "keys", "dict", "pairs", "found", "cand", "raw", "cw", "wc", "top", "refs", "ent", "tot", "rows", "bia",
)
variant(
    "s",
    {
        "edg": ("wrd", "select doc_id, src, dst from (select doc_id, mention_id as src, lead(mention_id) over (partition by doc_id, sent_id order by i) as dst from wrd) where dst is not null"),
        "ver": ("wc", "select doc_id, mention_id as v, avg(w) as w from wc group by all"),
    },
    "edg", "ver", "und", "adj", "vb",
)


def settled_meanings(select: str, prefix: str = "", steps: int = 40, more: tuple[str, ...] = ()) -> str:
    """The iteration until a document settles, unrolled; a select over the part ``last`` (doc_id, ref, p)."""
    p = prefix
    out = [f"v0 as materialized (select doc_id, ref, 1.0 / count(*) over (partition by doc_id) as p, false as done from {p}refs)"]
    for k in range(1, steps + 1):
        sums = f"select v.doc_id, sum(p) as total, sum(p * fill / rs) as base from v{k - 1} v join {p}rows r on r.doc_id = v.doc_id and r.a = v.ref group by all"
        moved = f"select e.doc_id, e.b as ref, sum((e.value - fill) / rs * p) as x from {p}ent e join v{k - 1} v on v.doc_id = e.doc_id and v.ref = e.a join {p}rows r on r.doc_id = e.doc_id and r.a = e.a group by all"
        raw = f"select b.doc_id, b.ref, 0.6 * l * total + 0.4 * (base + coalesce(x, 0)) as q, v.p as old, v.done from {p}bia b join ({sums}) s using (doc_id) left join ({moved}) m using (doc_id, ref) join v{k - 1} v using (doc_id, ref)"
        out.append(_settle(k, raw, "ref"))
    head = build("", *(p + x for x in ("ent", "tot", "rows", "bia", "refs")), *more).rstrip()
    return head + ",\n" + ",\n".join(out) + f",\nlast as (select doc_id, ref, p from v{steps})\n{select}"


def _settle(k: int, raw: str, key: str) -> str:
    shares = f"select doc_id, {key}, old, done, q / sum(q) over (partition by doc_id) as fresh, count(*) over (partition by doc_id) as n from ({raw})"
    return f"v{k} as materialized (select doc_id, {key}, case when done then old else fresh end as p, done or max(abs(fresh - old)) over (partition by doc_id) < 1.0 / (1000 * n) as done from ({shares}))"


def settled_vertices(select: str, prefix: str = "", steps: int = 60) -> str:
    p = prefix
    out = [f"v0 as materialized (select doc_id, v, 1.0 / count(*) over (partition by doc_id) as p, false as done from {p}ver)"]
    for k in range(1, steps + 1):
        moved = f"select adj.doc_id, adj.b as v, sum(value * p) as x from {p}adj adj join v{k - 1} r on r.doc_id = adj.doc_id and r.v = adj.a group by all"
        raw = f"select vb.doc_id, vb.v, 0.2 * t * total + 0.8 * coalesce(x, 0) as q, o.p as old, o.done from {p}vb vb join (select doc_id, sum(p) as total from v{k - 1} group by all) using (doc_id) left join ({moved}) m using (doc_id, v) join v{k - 1} o using (doc_id, v)"
        out.append(_settle(k, raw, "v"))
    return build("", *(p + x for x in ("adj", "vb", "ver"))).rstrip() + ",\n" + ",\n".join(out) + f",\nlast as (select doc_id, v, p from v{steps})\n{select}"


def heads(groups: str) -> str:
    """Each vertex of a group of several into its heaviest one; of several groups into the least."""
    best = f"select *, first_value(v) over (partition by doc_id, group_id order by w desc, v) as t, min(v) over (partition by doc_id, group_id) <> max(v) over (partition by doc_id, group_id) as several from ({groups})"
    return f"select doc_id, v, min(t) as t from ({best}) where several and v <> t group by all"


_SCORE = "select '{name}' as system, round(s / n, 6) as precision, round(s / g, 6) as recall, round(2 * (s / n) * (s / g) / (s / n + s / g), 6) as f1 from (select sum((a.ref = gld.ref)::int) as s, count(a.ref) as n, count(*) as g from gld left join {answers} a using (key))"
_CHOSEN = "select doc_id, mention_id, ref from (select t.*, row_number() over (partition by doc_id, mention_id order by round(coalesce(p, 0), 9) desc, ord) as k from mtop t left join last using (doc_id, ref)) where k = 1"

SQL: dict[str, str] = {
    "p2_found": build("select file_id, line_no, reason from judged where reason is not null", "judged"),
    "p2_loaded": build("select file_id, line_no, item, list_transform(numbers, lambda x: x::double) as vectors from judged where reason is null", "judged"),
    "p4_found": build("select batch_id, text_no, -1 as sentence_no, -1 as token_no from tx union all select batch_id, text_no, sentence_no, -1 from se union all select batch_id, text_no, sentence_no, token_no from tk", "tk"),
    "p4_tokens": build(f"select batch_id, text_no, sentence_no, token_no, {leaf('id', '@id', '_id')} as tok_id, {leaf('lemma', '@lemma', '_lemma')} as lemma, {leaf('pos', '@pos', '_pos')} as pos, case when json_type(r) = 'OBJECT' then {leaf('wf', '#text', '_VALUE', 'form')} else r ->> '$' end as wf from tk", "tk"),
    "rank_meanings": settled_meanings("select doc_id, ref, round(p, 6) as rank, row_number() over (partition by doc_id order by round(p, 9) desc, ref) as k from last"),
    "rank_vertices": settled_vertices("select doc_id, v, round(p, 6) as rank from last"),
    "rank_mentions": settled_vertices("select doc_id, v as mention_id, round(p, 6) as rank from last", "s"),
    "disambiguated_mentions": settled_meanings(_CHOSEN, "m"),
    "system_scores": settled_meanings("", "m", more=("gld", "sys")),
    "sif_vectors": build(f"select doc_id, list(round(x - y, 6) order by k) as vec from sifr join (select doc_id, i as k, sum(m * x) as y from sifr join mom{SQUARES} on j = k group by all) using (doc_id, k) group by doc_id", "sifr", f"mom{SQUARES}"),
    "similarity_pairs": build(f"select doc_id, n * (n - 1) // 2 as n_pairs, coalesce(valid, 0) as n_valid, coalesce(valid, 0) as n_defined, coalesce(filtered, 0) as n_filtered, coalesce(negative, 0) as n_negative from (select doc_id, count(*) as n from refs group by all) left join (select a.doc_id, count_if(a.ms <> b.ms) as valid, count_if(a.ms <> b.ms and list_cosine_similarity(a.vec, b.vec) < {THRESHOLD}) as filtered, count_if(a.ms <> b.ms and list_cosine_similarity(a.vec, b.vec) < 0) as negative from refs a join refs b on a.doc_id = b.doc_id and a.ref < b.ref group by all) using (doc_id)", "refs"),
    "merged_entities": "",
    "token_counts": f"select doc_id, len(t) as n_tokens, len(list_distinct(t)) as n_distinct from (select doc_id, {words_of('text')} as t from documents)",
    "truncated_texts": "select doc_id, array_to_string(string_split(text, ' ')[1:10], ' ') as head from documents where text is not null",
    "paragraph_counts": r"select doc_id, count(*) as n, max(length(p)) as longest from (select doc_id, unnest(regexp_split_to_array(text, '\n\s*\n')) as p from documents where text is not null) group by all",
    "function_word_share": build(f"select lang, round(avg({content('form')}::int), 6) as content_share, count(*) as n from tok join (select distinct text_id as doc_id, lang from texts) using (doc_id) group by all", "tok"),
    "pos_counts": build("select pos, count(*) as n from tok group by all union all select 'CONTENT', count(*) from tok where pos <> 'X'", "tok"),
    "simple_tags": build(f"select {_SIMPLE} as simple, case when tag[1] in ('N', 'V', 'J', 'R') then tag[1] else 'X' end as letter, count(*) as n from (select (['NN', 'NNS', 'VB', 'VBD', 'JJ', 'RB', 'CD', 'DT'])[{h('form')} % 8 + 1] as tag from tok) group by all", "tok"),
    "context_tokens": build("select * from ctok", "ctok"),
    "ngram_mentions": build("select * from spn", "spn"),
    "study_mentions": build(f"select doc_id, sent_id, l::int as l, r::int as r, array_to_string(list_transform(s, lambda x: x.form), ' ') as form, array_to_string(list_transform(s, lambda x: x.lemma), ' ') as lemma, case when r - l > 1 then 'N' else s[1].pos end as pos from (select *, t[l + 1 : r] as s from (select *, unnest(range(l + 1, least(l + 5, len(t)) + 1)) as r from (select *, unnest(range(len(t))) as l from sent))) where (r - l = 1 or len(list_filter(s, lambda x: starts_with(x.pos, 'N'))) > 0) and len(list_filter(s, lambda x: regexp_full_match(x.form, {_PUNCTUATION}))) = 0", "sent"),
    "mentions_without_last": build("select spn.doc_id, spn.sent_id, l, r, pos from spn join sent using (doc_id, sent_id) where r < len(t)", "spn", "sent"),
    "contained_spans": build("select doc_id, sent_id, ol, \"or\", l, r from (select *, unnest(range(l + 1, \"or\" + 1))::int as r from (select doc_id, sent_id, l as ol, r as \"or\", unnest(range(l, r))::int as l from spn)) join (select doc_id, sent_id, l, r from spn) using (doc_id, sent_id, l, r) where l <> ol or r <> \"or\"", "spn"),
    "maximal_spans": build(f"select * from ws m where not exists (select 1 from ws c where c.doc_id = m.doc_id and c.sent_id = m.sent_id and m.l <= c.l and m.r >= c.r and (m.l, m.r) <> (c.l, c.r) and c.w >= m.w) and not exists (select 1 from ws o where o.doc_id = m.doc_id and o.sent_id = m.sent_id and o.l <= m.l and o.r >= m.r and (m.l, m.r) <> (o.l, o.r) and o.w > m.w)", "spn").replace("\nselect * from ws", f",\nws as materialized (select doc_id, sent_id, l, r, {h('form')} % 1000 as w from spn)\nselect * from ws", 1),
    "candidate_lookup": build("select * from cand", "cand"),
    "candidate_lookup_unordered": build("select distinct doc_id, mention_id, ref from wrd join dict on key = lemma or key = form", "wrd", "dict"),
    "same_mention_meanings": build("select doc_id, array_to_string(ms, ',') as ms, array_to_string(list(ref order by ref), ',') as refs from (select doc_id, ref, list(mention_id order by mention_id) as ms from cand group by all) group by doc_id, ms", "cand"),
    "overlapping_meanings": build("select distinct a.doc_id, a.ref as a, b.ref as b from cand a join cand b on a.doc_id = b.doc_id and a.mention_id = b.mention_id and a.ref < b.ref", "cand"),
    "top_candidates": build("select doc_id, mention_id, ref, ord from wc qualify row_number() over (partition by doc_id, mention_id order by ord) <= 1 or w >= 0.55", "wc"),
    "choose_first": build("select doc_id, mention_id, ref from cand where ord = 1", "cand"),
    "choose_random": build("select doc_id, mention_id, ref from (select *, row_number() over (partition by doc_id, mention_id order by md5(concat_ws('|', doc_id, mention_id, ref, 0)), ord) as k from cand) where k = 1", "cand"),
    "choose_context": best("wc", "rw desc, ord", "wc"),
    "choose_context_or_first": best("wc", "case when top >= 0.55 then rw else 0 end desc, ord", "wc"),
    "choose_ranked_or_first": best("wc", "case when w >= 0.55 then rw else 0 end desc, ord", "wc"),
    "choose_ranked": best("wc", "rw desc, ord", "wc", "w >= 0.55"),
    "cosine_pairs": f"select * from ({_SIMILAR}) where c >= 0.2",
    "top_neighbours": f"select * from (select *, row_number() over (partition by a order by c desc, b) as k from ({_SIMILAR})) where k <= 5",
    "bow_vectors": build("select doc_id, list_transform(vec, lambda x: round(x, 6)) as vec from ctx", "ctx"),
    "gloss_vectors": build(f"select ref, list(x order by k) as vec from (select ref, k, round(avg(vec[k]), 6) as x from g join mean on mean.ref0 = {h('form')} % (select v from nref), (select unnest(range(1, 65)) as k) group by all) group by ref", "nref").replace("\nselect ref, list", f",\nmean as (select vec_id as ref0, embedding::double[] as vec from embeddings),\ng as (select ref, form from (select doc_id as ref, unnest({words_of('text')}) as form from documents where text is not null) where {content('form')})\nselect ref, list", 1),
    "context_weights": build("select doc_id, ref, round(w, 6) as w from cw", "cw"),
    "file_vectors": build("select * from filevec", "filevec"),
    "file_vector_lines": build("select file_id || '/' || item || ' ' || array_to_string(list_transform(vec, lambda x: printf('%.6f', x)), ' ') as text from filevec", "filevec"),
    "fallback_vectors": "select item, list_transform(coalesce(e.embedding, u.embedding)::double[], lambda x: round(x, 6)) as vec from (select distinct 'w' || vec_id as item from text_vectors where vec_id is not null) left join (select case vec_id when 7 then 'UNK' when 9 then '<unk>' else 'w' || vec_id end as item, embedding from embeddings) e using (item), (select embedding from embeddings where vec_id = 7) u",
    "inverse_weights": build("select item, round(coalesce(w, (select min(w) from iw)), 6) as w from (select distinct lemma as item from tok) left join iw using (item)", "tok").replace("\nselect item", ",\niw as materialized (select item, max(w) as w from (select unnest(map_keys(weighter)) as item, unnest(map_values(weighter)) as w from texts) group by all)\nselect item", 1),
    "sim_matrix_thresholded": build("select doc_id, a, b, round(value, 6) as value from ent", "ent"),
    "sim_matrix_filled": build("select doc_id, a, b, round(value, 6) as value from ent union all select doc_id, a, null, round(fill, 6) from rows where rest > 0", "ent", "rows"),
    "sim_matrix_normalised": build("select doc_id, a, b, round(value / rs, 6) as value from ent join rows using (doc_id, a) union all select doc_id, a, null, round(fill / rs, 6) from rows where rest > 0", "ent", "rows"),
    "bias_vector": build("select doc_id, ref, round(l, 6) as l from bia", "bia"),
    "vertex_bias": build("select doc_id, v, round(t, 6) as t from vb", "vb"),
    "type_vector": build(f"select doc_id, ref, round(t / sum(t) over (partition by doc_id), 6) as t from (select doc_id, ref, case when mt <> '' and mt = type then 0.99 else 0.01 end as t from (select doc_id, cand.ref, max((['Location', 'Person', ''])[{h('form')} % 3 + 1]) as mt, max(type) as type from cand join wrd using (doc_id, mention_id) join mean on mean.ref = cand.ref group by all))", "cand", "wrd", "mean"),
    "power_iteration_3": iterate_meanings(3, True),
    "power_iteration_3_aw": iterate_meanings(3, False),
    "adjacency": build("select doc_id, a, b, round(value, 6) as value from adj", "adj"),
    "rank_vertices_3": iterate_vertices(3),
    "number_of_forms": build("select ref, round(n / max(n) over (), 6) as w from (select ref, count(distinct form) as n from ann group by all)", "ann"),
    "tf_idf": build("select doc_id, ref, round(w, 6) as w from (" + _SCALED.format(x=_TFIDF.format(tf="(1 + ln(f))")) + ")", "ann"),
    "tf_idf_aw": build("select doc_id, ref, round(avg(w) over (partition by doc_id), 6) as w from (" + _SCALED.format(x=_TFIDF.format(tf="1")) + ")", "ann"),
    "form_meaning_prior": build("select form, ref, round(n / sum(n) over (partition by form), 6) as p from (select form, ref, count(*) as n from ann group by all)", "ann"),
    "meaning_frequencies": build("select ref, count(*) as n, count(distinct doc_id) as docs from ann group by all", "ann"),
    "form_frequencies": build("select form, count(*) as n from ann group by all", "ann"),
    "annotation_counts": r"select form, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(regexp_extract_all(text, '\(([a-z]+[0-9]*) / ([^\s()]+)', 2)) as form from documents where text is not null) group by all",
    "coverage": build(f"select doc_id, count(*) as n_tokens, count(p) as covered, count_if(coalesce(multi, false)) as covered_by_multiword, round(avg(p) + 1e-9, 6) as polysemy from pl left join (select doc_id, sent_id, i, avg(1 + {h('lemma')} % 3) as p, max((r - l > 1)::int) = 1 as multi from (select *, unnest(range(l, r)) as i from spn) group by all) using (doc_id, sent_id, i) group by all", "tok", "spn").replace("\nselect doc_id, count", ",\npl as materialized (select doc_id, sent_id, i from tok)\nselect doc_id, count", 1),
    "similarity_stats": build("select doc_id, n_meanings, n_meanings * (n_meanings - 1) // 2 as n_pairs, coalesce(n_similar, 0) as n_similar, round(mean, 6) as mean from (select doc_id, count(*) as n_meanings from refs group by all) left join (select doc_id, count(*) as n_similar, avg(value) as mean from ent where a < b group by all) using (doc_id)", "ent", "refs"),
    "text_statistics": f"select source, count(x) as n, {_STATS} from (select source, n_chars::double as x from documents) group by all",
    "entity_counts": build(f"select ner, count(*) as n_mentions, sum(r - l)::bigint as n_tokens, count(distinct doc_id) as n_docs from (select *, (['LOC', 'PER', '', ''])[{h('form')} % 4 + 1] as ner from spn) where ner <> '' group by all", "spn"),
    "meaning_statistics": build("select count(*) as n_meanings, count(l) as with_lemmas, count(l) as n_lemmas, count_if(coalesce(source = '', false)) as empty_lemmas, coalesce(sum(len(l)), 0)::bigint as tokens_lemmas, round(coalesce(avg(len(l)) filter (source <> ''), 0), 6) as mean_tokens_lemmas, count(g) as with_glosses, count(g) as n_glosses, count_if(text = '') as empty_glosses, coalesce(sum(len(g)), 0)::bigint as tokens_glosses, round(coalesce(avg(len(g)) filter (text <> ''), 0), 6) as mean_tokens_glosses, count(*) as with_either, count(distinct l) filter (list_has_any(l, f)) as defined_lemmas, count(distinct g) filter (list_has_any(g, f)) as defined_glosses, count(distinct list_concat(g, coalesce(l, []))) filter (list_has_any(list_concat(g, coalesce(l, [])), f)) as defined_both from m, f", "tok").replace("\nselect count", ",\nf as materialized (select list(distinct form) as f from tok),\nm as materialized (select text, source, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as g, case when source is not null then list_filter(string_split(source, '_'), lambda x: x <> '') end as l from documents where text is not null)\nselect count", 1),
    "limited_meanings": "select doc_id as ref from documents where text <> '' or source is not null order by doc_id limit 50",
    "top_ranks": build("select doc_id, ref, round(w, 6) as rank from cw order by round(w, 9) desc, doc_id, ref limit 100", "cw"),
    "chosen_lines": build("select format('{}.t{:03d}', sent_id, i + 1) as first_tok, format('{}.t{:03d}', sent_id, i + 1) as last_tok, ref from cand join wrd using (doc_id, mention_id) where ord = 1", "cand", "wrd"),
    "candidate_priors": build("select doc_id, mention_id, ref, round(coalesce(p, 0), 6) as p from cand join (select mention_id, form from wrd) using (mention_id) left join (select form, ref, n / sum(n) over (partition by form) as p from (select form, ref, count(*) as n from ann group by all)) using (form, ref)", "cand", "wrd", "ann"),
    "reset_candidates": build("select doc_id, mention_id, ref, 0.0::double as weight from wc", "wc"),
    "type_counts": build("select type, count(*) as n from mean group by all", "mean"),
    "vector_items": build("select distinct item from filevec", "filevec"),
    "random_vectors": build(f"select item, list_transform(range(8), lambda i: round({h("concat_ws('_', item, i, '0')")} / 268435456.0, 6)) as vec from (select distinct lemma as item from tok)", "tok"),
    "tagset_counts": build(f"""select lang, tag, case lang when 'en' then case when tag[1:2] = 'NN' then 'N' when tag[1:2] = 'VB' then 'V' when tag[1:2] = 'JJ' then 'J' when tag[1:2] = 'RB' then 'R' else 'X' end
      when 'de' then case when tag[1:3] = 'ADJ' then 'J' when tag[1:3] = 'ADV' then 'R' when tag[1:2] in ('NN', 'NE') then 'N' when tag[1:2] in ('VV', 'VA', 'VM') then 'V' else 'X' end
      when 'es' then case tag[1] when 'n' then 'N' when 'v' then 'V' when 'a' then 'J' when 'r' then 'R' else 'X' end
      when 'fr' then case when tag[1:3] = 'ADJ' then 'J' when tag[1:3] = 'ADV' then 'R' when tag[1] = 'N' then 'N' when tag[1] = 'V' then 'V' when tag[1] = 'A' then 'J' else 'X' end
      when 'tr' then case when tag[1:4] = 'Noun' then 'N' when tag[1:4] = 'Verb' then 'V' when tag[1:3] = 'Adj' then 'J' when tag[1:3] = 'Adv' then 'R' else 'X' end else 'X' end as simple, count(*) as n
      from (select *, (['NNS', 'VVFIN', 'ADJA', 'n0', 'vmip', 'Noun', 'ADV', 'RBR'])[{h('form')} % 8 + 1] as tag from tok join (select distinct text_id as doc_id, lang from texts) using (doc_id)) group by all""", "tok"),
    "plain_tokens": r"select doc_id, count(*) as n_tokens, count(distinct s) as n_sentences, max(format('t{}.s{}.t{}', doc_id, s + 1, i + 1)) as last from (select doc_id, s, unnest(range(len(w))) as i from (select doc_id, s, list_filter(regexp_split_to_array(line, '\s+'), lambda x: x <> '') as w from (select doc_id, unnest(range(len(l))) as s, unnest(l) as line from (select doc_id, regexp_split_to_array(text, '\n+') as l from documents where text is not null)))) group by all",
    "ngram_spans": build("select doc_id, sent_id, l::int as l, r::int as r, array_to_string(list_transform(t[l + 1 : r], lambda x: x.form), ' ') as form from (select *, unnest(range(l + 1, least(l + 3, len(t)) + 1)) as r from (select *, unnest(range(len(t))) as l from sent))", "sent"),
    "predicate_edges": build("select a.doc_id, a.v as src, b.v as dst, 'over' as role from ver a join ver b on a.doc_id = b.doc_id and a.v % 50 = b.v % 50 and a.v <> b.v and a.w > b.w", "ver"),
    "vertex_depths": build("select doc_id, v, min(depth)::int as depth from reach group by all", "edg").replace("with ", "with recursive ", 1).replace("\nselect doc_id, v, min(depth)", ",\nup as materialized (select doc_id, src, dst from edg where src < dst),\nreach as (select doc_id, min(src) as v, 0 as depth from up group by doc_id union select r.doc_id, u.dst, r.depth + 1 from reach r join up u on u.doc_id = r.doc_id and u.src = r.v)\nselect doc_id, v, min(depth)", 1),
    "dependency_edges": build("select doc_id, src, dst, role, w from (select doc_id, sent_id || '_' || i as src, sent_id || '_' || lead(i) over p as dst, pos as role, case when pos = 'N' then 0.5 else 0 end::double as w from tok window p as (partition by doc_id, sent_id order by i)) where dst is not null", "tok"),
    "subgraph_weights": build("select doc_id, v % 7 as sg_id, round(coalesce(avg(nullif(w, 0)), 0), 6) as w from ver group by all", "ver"),
    "mention_weights": build("select distinct doc_id, mention_id, round(coalesce(w, 0), 6) as w from wrd left join (select doc_id, mention_id, max(w) as w from wc group by all) using (doc_id, mention_id)", "wrd", "wc"),
    "meaning_average": build(f"select doc_id, ref, round(avg({h('mention_id || chr(95) || ref::varchar')} % 100 / 100), 6) as weight from cand group by all", "cand"),
    "windowed_terms": "select time_bucket(interval 7 days, loaded_at::timestamp, timestamp '1970-01-01') as start, lemma as term, count(*) as n from tokens where lemma <> '' group by all",
    "wsd_scores": build("select round(s / n, 6) as precision, round(s / g, 6) as recall, round(2 * (s / n) * (s / g) / (s / n + s / g), 6) as f1 from (select sum((sys.ref = gld.ref)::int) as s, count(sys.ref) as n, count(*) as g from gld left join sys using (key))", "gld", "sys"),
    "mean_average_precision": build("select round(avg(ap), 6) as map, count(*) as n_docs from (select doc_id, avg(p) as ap from (select doc_id, hit, sum(hit) over (partition by doc_id order by k) / k as p from (select cw.doc_id, row_number() over (partition by cw.doc_id order by round(w, 9) desc, cw.ref) as k, (g.ref is not null)::int as hit from cw left join (select distinct doc_id, ref from gld) g on g.doc_id = cw.doc_id and g.ref = cw.ref)) where hit = 1 group by doc_id)", "cw", "gld"),
    "threshold_sweep": build("select t as threshold, round(sum(ok) filter (w >= t) / nullif(count_if(w >= t), 0), 6) as precision, round(coalesce(sum(ok) filter (w >= t), 0) / count(*), 6) as recall from (select top.w, (top.ref = gld.ref)::int as ok from gld left join (select mention_id as key, ref, round(w, 9) as w from wc qualify row_number() over (partition by mention_id order by round(w, 9) desc, ord) = 1) top using (key)), (select unnest([0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])::double as t) group by t", "gld", "wc"),
    "candidate_report": build("select case when s.ref is not null and g.ref is not null then 'OK' when s.ref is not null then 'FAIL' when g.ref is not null then 'GOLD' when w >= 0.55 then 'RANKED' else '' end as mark, count(*) as n from wc left join (select distinct key, ref from gld) g on g.key = wc.mention_id and g.ref = wc.ref left join sys s on s.key = wc.mention_id and s.ref = wc.ref group by all", "wc", "gld", "sys"),
    "mention_softmax": build("select doc_id, mention_id, ref, round(p, 6) as p from smx", "smx"),
    "salience_values": build("select doc_id, round(sum(p * w), 6) as value from smx group by all", "smx"),
    "type_values": build("select doc_id, round(sum(case when type = 'Location' then p else 0 end), 6) as value from smx join mean using (ref) group by all", "smx", "mean"),
    "coherence_values": build(f"select doc_id, round(coalesce(v, 0), 6) as value from (select distinct doc_id from smx) left join (select a.doc_id, sum(a.p * b.p * least(list_cosine_similarity(m.vec, n.vec), 1.0)) as v from smx a join smx b on a.doc_id = b.doc_id and a.mention_id <> b.mention_id join mean m on m.ref = a.ref join mean n on n.ref = b.ref where list_cosine_similarity(m.vec, n.vec) >= {THRESHOLD} group by all) using (doc_id)", "smx", "mean"),
    "contracted_edges": build(_CONTRACT.format(e="edg", m="mp"), "edg", "ver").replace("\nselect doc_id, a as src", ",\nmp as materialized (select doc_id, v, t from (select doc_id, v, min(v) over (partition by doc_id, v % 7) as t from ver) where v <> t)\nselect doc_id, a as src", 1),
    "components": build("select doc_id, v, min(u) as component from reach group by all", "und", "ver").replace("with ", "with recursive ", 1).replace("\nselect doc_id, v, min(u)", ",\nreach as (select doc_id, v, v as u from ver union select r.doc_id, r.v, x.b from reach r join und x on x.doc_id = r.doc_id and x.a = r.u)\nselect doc_id, v, min(u)", 1),
    "vertex_candidates": build("select doc_id, v, mention_id, ref from (select *, row_number() over (partition by doc_id, v order by (m and weight >= av - 1e-12)::int desc, weight desc, mention_id, ref) as k from (select *, avg(weight) over (partition by doc_id, v) as av from (select wc.doc_id, sent_id as v, wc.mention_id, ref, round(w, 6) as weight, ref % 2 = 0 as m from wc join wrd on wrd.mention_id = wc.mention_id and wrd.doc_id = wc.doc_id))) where k = 1", "wc", "wrd"),
    "role_edges": build("select case role when 'mod' then ':mod' when 'loc' then ':location' else ':ARG' || role[2] end as role, role in ('A0', 'A1') as core, case role when 'mod' then 'target' when 'loc' then null else 'source' end as needs, count(*) as n from edg group by all", "edg"),
}
SQL["system_scores"] += _SCORE.format(name="first", answers="sys") + "\nunion all " + _SCORE.format(name="ranked", answers=f"(select mention_id as key, ref from ({_CHOSEN}))")
SQL["merged_entities"] = build("", "known", "edg").rstrip() + f""",
m1 as materialized ({heads("select doc_id, type || '_' || (v % 7) as group_id, v, w from known")}),
m2 as materialized ({heads("select doc_id, type as group_id, v, w from known anti join m1 using (doc_id, v) where is_ne")}),
mp as materialized (select m1.doc_id, m1.v, coalesce(m2.t, m1.t) as t from m1 left join m2 on m2.doc_id = m1.doc_id and m2.v = m1.t union all select * from m2)
""" + _CONTRACT.format(e="edg", m="mp")

"""SQL for the operators whose whole result SQL can express, run by DuckDB over the same tables."""

from __future__ import annotations

from . import lines, neardup, phrases, rules, suffixes

WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
UPPER, LOWER = lines._UPPER, lines._LOWER
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _quality_rules() -> str:
    forms = ", ".join(f"('{form.decode()}', {at}, {rank})" for form, places in rules._FORMS.items() for at, rank in places)
    shares = ", ".join(f"({k}, {float(v)!r})" for k, v in enumerate(rules._SHARES[:-1]))
    languages = ", ".join(f"({k})" for k in range(len(rules.COMMON)))
    prose = list(rules.CLASSES.values())

    def term(p: str, q: str) -> str:
        m = f"(({p} + {q}) / 2)"
        return f"(case when {p} > 0 then {p} * log2({p} / {m}) else 0 end + {q} * log2({q} / {m}))"

    classes = " + ".join(term(f"({c} / chars)", repr(float(v))) for c, v in zip(("lower", "upper", "space", "punct", "symbol"), prose, strict=True))
    rest = float(rules._SHARES[-1])
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, {WORDS} as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
c as (select doc_id, len(w) as n, cast(length(t) as double) as chars,
    cast(length(regexp_replace(t, '[^A-Z]', '', 'g')) as double) as upper, cast(length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g')) as double) as space,
    cast(length(regexp_replace(t, '[^.,;:!?''"()\-]', '', 'g')) as double) as punct,
    cast(length(regexp_replace(t, '[A-Za-z0-9\x20\x09-\x0D.,;:!?''"()\-]|[^\x00-\x7f]', '', 'g')) as double) as symbol,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) as word_chars from d),
dup as (select doc_id, sum(k - 1) as n from (select doc_id, line, count(*) as k from (select doc_id, unnest(l) as line from d) where trim(line, {BLANK}) <> '' group by all) group by 1),
win as (select doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] as s from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d)),
rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from (select *, count(*) over (partition by doc_id, s) as k from win) where k > 1) group by 1),
f(form, lang, rank) as (values {forms}), share(rank, q) as (values {shares}), langs(lang) as (values {languages}),
hit as (select doc_id, lang, rank, count(*) as k from (select doc_id, unnest(w) as form from d) join f using (form) group by all),
every as (select c.doc_id, c.n, lang, rank, q, coalesce(k, 0) as k from c cross join langs cross join share left join hit using (doc_id, lang, rank) where c.n >= {rules.MIN_WORDS}),
dist as (select doc_id, n, lang, sum({term("(k / cast(n as double))", "q")}) as js, sum(k) as k from every group by all),
word as (select doc_id, min(sqrt(greatest(0, (js + {term("((n - k) / cast(n as double))", repr(rest))}) / 2))) as wd from dist group by 1),
s as (select c.*, coalesce(dup.n, 0) as dups, coalesce(rep.n, 0) as reps, c.n < {rules.MIN_BASE_WORDS} or 100 * coalesce(rep.n, 0) > {rules.MAX_REPEAT_PERCENT} * c.n as failed, wd,
    chars - upper - space - punct - symbol as lower from c left join dup using (doc_id) left join rep using (doc_id) left join word using (doc_id))
select doc_id, n as n_words, word_chars, n_symbols, cast(dups as bigint) as n_dup_lines, reps as n_repeat_words, failed as base_failed,
    not failed and not (chars >= {rules.MIN_CHARS} and sqrt(greatest(0, ({classes}) / 2)) > {rules.CLASS_LIMIT} + {rules.CLASS_NOISE} / sqrt(chars))
    and not (n >= {rules.MIN_WORDS} and wd > {rules.WORD_LIMIT} + {rules.WORD_NOISE} / sqrt(n)) as kept from s"""


def _line_dedup() -> str:
    return f"""
with l as (select doc_id, p, ls[p] as line, translate(trim(ls[p], {BLANK}), '{UPPER}', '{LOWER}') as k from
    (select doc_id, ls, unnest(range(1, len(ls) + 1)) as p from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents))),
hot as (select k, max(doc_id) as keeper from l where length(k) >= {lines.MIN_CHARS} group by k having count(distinct doc_id) >= {lines.MIN_DOCUMENTS}),
m as (select l.*, keeper is not null and keeper <> doc_id as gone from l left join hot using (k))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by p) filter (where not gone), '')) as kept_sha256 from m group by 1"""


def _near_dedup() -> str:
    return f"""
with recursive d as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as w from documents),
s as (select distinct doc_id, g from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as g from d)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b using (g) where a.doc_id < b.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= {neardup.SIMILARITY_PERCENT} * (x.n + y.n - k)),
e2 as (select a, b from e union all select b, a from e),
r as (select doc_id as a, doc_id as b from d union select r.a, e2.b from r join e2 on r.b = e2.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.m as component_id, c.m = d.doc_id as kept from d left join n using (doc_id) join (select a, min(b) as m from r group by 1) c on c.a = d.doc_id"""


def _suffix_dedup() -> str:
    w = suffixes.LENGTH
    return f"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents),
win as (select doc_id, i, md5(substr(h, 2 * i + 1, {2 * w})) as s from (select doc_id, h, unnest(range(0, n - {w} + 1)) as i from d)),
twice as (select doc_id, i from (select *, count(*) over (partition by s) as k from win) where k > 1),
spans as (select doc_id, min(i) as a, max(i) + {w} as b from
    (select *, sum(new) over (partition by doc_id order by i) as g from (select *, case when i - lag(i) over (partition by doc_id order by i) <= {w} then 0 else 1 end as new from twice)) group by doc_id, g),
cut as (select doc_id, list(a order by a) as a, list(b order by a) as b, sum(b - a) as gone, count(*) as k from spans group by 1),
kept as (select doc_id, string_agg(substr(h, 2 * x + 1, 2 * (y - x)), '' order by x) as h from
    (select doc_id, h, unnest(list_concat([0], coalesce(b, []))) as x, unnest(list_concat(coalesce(a, []), [n])) as y from d left join cut using (doc_id)) group by 1)
select d.doc_id, n as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, coalesce(k, 0) as n_spans, sha256(unhex(coalesce(kept.h, ''))) as kept_sha256 from d left join cut using (doc_id) join kept using (doc_id)"""


def _phrase_dedup() -> str:
    w = phrases.WORDS
    return f"""
with d as (select doc_id, {WORDS} as w from documents),
win as (select doc_id, i, array_to_string(list_slice(w, i, i + {w - 1}), ' ') as s from (select doc_id, w, unnest(range(1, len(w) - {w} + 2)) as i from d)),
twice as (select doc_id, i from (select *, count(*) over (partition by s) as k from win) where k > 1),
gone as (select distinct doc_id, i + j as p from twice cross join (select unnest(range(0, {w})) as j)),
one as (select doc_id, p, w[p] as word from (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d)),
kept as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as t from one anti join gone using (doc_id, p) group by 1)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from d left join kept using (doc_id)"""


SQL = {
    "op3_quality_rules": _quality_rules(),
    "op5_line_dedup": _line_dedup(),
    "op6_minhash_near_dedup": _near_dedup(),
    "op9_suffix_array_dedup": _suffix_dedup(),
    "op10_substring_dedup": _phrase_dedup(),
}

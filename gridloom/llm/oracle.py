"""DuckDB SQL of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

import re

from gridloom.llm import license_scan, quality_rules, secret_scan


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def quality_sql() -> str:
    """Words, windows and lines as rows; line rules as RE2 expressions."""
    q = quality_rules
    word, symbol = f"[^{q.SPACE_CLASS}]", f"[{q.SYMBOLS}]"
    less = lambda x, c: f"(length({x}) - length(regexp_replace({x}, {quoted(c)}, '', 'g')))"
    good = (
        f"not regexp_matches(x, {quoted(word)}) or (regexp_matches(x, {quoted(q.SENTENCE_END)}) and {less('x', symbol)} * 100 <= length(x) * {q.SYMBOL_PCT} and {less('x', '[!?]')} * 100 <= length(x) * {q.SHOUT_PCT} "
        f"and not regexp_matches(x, {quoted(q.NAVIGATION)}) and not (length(x) <= {q.BOILERPLATE_CHARS} and regexp_matches(x, {quoted(q.BOILERPLATE)})))"
    )
    return f"""
with d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), {quoted(word + '+')}) as w from documents),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
r as (select doc_id, i from g qualify count(*) over (partition by doc_id, g) > 1),
c as (select doc_id, count(distinct i + k) as n_repeat_words from r, (values (0), (1), (2)) o(k) group by 1),
x as (select doc_id, unnest(string_split(t, chr(10))) as x from d),
l as (select doc_id, x, {good} as ok from x),
s as (select doc_id, sum(length(x)) as chars, count(*) filter (not ok) as n_bad_lines, coalesce(sum(length(x)) filter (not ok), 0) as lost_chars,
  count(x) filter (regexp_matches(x, {quoted(word)})) - count(distinct x) filter (regexp_matches(x, {quoted(word)})) as n_dup_lines from l group by 1),
a as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, {less('t', symbol)}::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words, n_bad_lines::bigint as n_bad_lines, lost_chars::bigint as lost_chars, chars from d join s using (doc_id) left join c using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from a)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and lost_chars * 100 <= chars * 50 as kept, n_bad_lines, lost_chars from f"""


def warc_sql() -> str:
    """Digests, and the least page of each payload; base32 goes by groups of five bytes."""
    chars = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v{i} >> {35 - 5 * j}) & 31)::int, 1)" for i in range(4) for j in range(8))
    groups = ", ".join(f"('0x' || substr(h, {1 + 10 * i}, 10))::bigint as v{i}" for i in range(4))
    return f"""
with p as (select page_id, coalesce(html, '') as t, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as least from pages),
v as (select *, {groups} from p)
select page_id, strlen(t)::bigint as payload_bytes, {chars} as payload_digest, case when page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id <> least then least end as refers_to from v"""


def places(rows: str, keys: str, expression: str, length: str = "length", group: int = 0) -> str:
    """The matches of an expression in column t of ``rows``: ``keys``, match, its group, and start, as ``length`` counts text."""
    return (
        f"select {keys}, m, g, (sum({length}(p)) over w + coalesce(sum({length}(m)) over (w rows between unbounded preceding and 1 preceding), 0))::bigint as s from "
        f"(select {keys}, unnest(range(1, len(ms) + 1)) as k, ms[k] as m, ps[k] as p, gs[k] as g from "
        f"(select {keys}, regexp_extract_all(t, {expression}) as ms, string_split_regex(t, {expression}) as ps, regexp_extract_all(t, {expression}, {group}) as gs from {rows})) window w as (partition by {keys} order by k)"
    )


def secret_sql() -> str:
    """Each rule's matches; RE2 finds them leftmost and greedy."""
    any_case = lambda x: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x)
    found = []
    for k, r in enumerate(secret_scan.RULES):
        regex, group = r.head + r.body, 0
        if r.kind == "assign":
            regex, group = any_case("(password|passwd|secret|token|api_?key)") + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2
        elif r.run:  # a word, spaces, and the value, whose length counts
            word, spaces, value = re.fullmatch(r"(\w+)(\\x20\+)(.*)", r.head).groups()
            regex, group = f"{word}{spaces}({value}{r.body})", 1
        found.append(f"select doc_id, {k} as rule, '{r.kind}' as kind, s, s + length(m) as e from ({places('d', 'doc_id', quoted(regex), group=group)}) where length(g) >= {r.least}")
    base = "('assign', 'access', 'hex')"
    joined = "string_agg(concat_ws(':', kind, s, e), ',' order by s, rule)"
    counts = ", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in ("assign", "access", "hex"))
    counted = ", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in ("assign", "access", "hex"))
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), f as ({' union all '.join(found)}),
a as (select doc_id, {counted}, {joined} filter (kind in {base}) as base, {joined} as spans from f group by 1)
select doc_id, {counts}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans from d left join a using (doc_id)"""


def license_sql() -> str:
    """Rules meet the texts that hold what every match of them holds; a hit within another of its priority or a higher one goes."""
    ls = license_scan
    rules = ", ".join(f"({s.order}, {s.priority}, {s.confidence}::double, {quoted(s.label)}, {quoted(s.spdx)}, {quoted(s.form)}, {quoted(s.name)}, {quoted(s.regex)})" for s in ls.signatures())
    spaces = lambda x: f"((length({x}) - length(replace({x}, ' ', ''))) // 2)"
    base = " union all ".join(
        f"select doc_id, '{label}' as label, len(b) - 1 as n, {spaces('b[1]')} as first_word, n_words - {spaces('b[-1]')} - {len(p.split())} as last_word from (select *, string_split(t, {quoted(ls.keyword_text(p))}) as b from n) where len(b) > 1"
        for p, label in ls.BASE
    )
    return f"""
with w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{ls.UPPER}', '{ls.LOWER}'), {quoted('[^' + ls.NOT_WORD[1:])}) as w from documents),
n as (select doc_id, len(w)::bigint as n_words, case when len(w) = 0 then '' else ' ' || array_to_string(w, '  ') || ' ' end as t from w),
r(o, priority, confidence, label, spdx, form, name, re) as (values {rules}),
j as (select doc_id, t, o, re from n join r on contains(t, form) and contains(t, name)),
m as ({places('j', 'doc_id, o', 're')}),
h0 as (select doc_id, o, priority, confidence, label, spdx, {spaces('left(t, s::int)')} as s, {spaces('left(t, (s + length(m))::int)')} as e from m join r using (o) join n using (doc_id)),
h as (select * from h0 a where not exists (select 1 from h0 b where b.doc_id = a.doc_id and b.s <= a.s and b.e >= a.e and b.o <> a.o
  and ((b.s = a.s and b.e = a.e and b.o < a.o) or (b.e - b.s > a.e - a.s and b.priority <= a.priority)))),
b as ({base}),
bs as (select doc_id, sum(n) as n_base, min(first_word) as first_word, max(last_word) as last_word, string_agg(distinct label, ',' order by label) as base_labels from b group by 1),
ls as (select doc_id, string_agg(distinct label, ',' order by label) as labels from (select doc_id, label from b union all select doc_id, label from h) group by 1),
sc as (select doc_id, max(confidence) as score, string_agg(distinct spdx, ',' order by spdx) filter (spdx <> '') as identifiers from h group by 1)
select doc_id, n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, case when n_base > 0 then 0.5 else 0.0 end)::double as score, coalesce(identifiers, '') as identifiers from n left join bs using (doc_id) left join ls using (doc_id) left join sc using (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": quality_sql(), "op3_warc": warc_sql(), "op8_license_scan": license_sql(), "op10_secret_scan": secret_sql()}

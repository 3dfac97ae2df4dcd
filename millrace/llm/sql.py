"""SQL of the queries that SQL can express whole."""

from __future__ import annotations

from millrace.llm import license_scan

#: The classes of texts whose 5-word shingle sets have a Jaccard similarity of 0.75 or more.
OP4 = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
s as (
  select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end as s
  from w),
e as (select doc_id, unnest(s) as g from s),
n as (select doc_id, len(s) as n from s),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (
  select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)),
ways as (select a, b from links union all select b, a from links),
reach as (select doc_id as a, doc_id as b from n union select reach.a, ways.b from reach join ways on ways.a = reach.b)
select n.doc_id, cast(n.n as bigint) as n_shingles, c.component_id
from n join (select a, min(b) as component_id from reach group by 1) c on c.a = n.doc_id
"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _op5() -> str:
    """Every template at every place of its first key phrase, and every place of the base phrases."""
    places = {}
    for phrase, label in license_scan.BASE.items():
        own = phrase.split()
        places[label] = f"case when list_has_all(w, {_list(own)}) then list_filter(range(1, len(w) + 1), lambda i: w[i:i + {len(own) - 1}] = {_list(own)}) else [] end"
    scores = []
    for _, wording, keys in license_scan.TEMPLATES:
        wanted = wording.split()
        at = [next(j for j in range(len(wanted)) if wanted[j : j + len(k.split())] == k.split()) for k in keys]
        whole = " and ".join(f"s + {p} >= 1 and w[greatest(s + {p}, 1):s + {p + len(k.split()) - 1}] = {_list(k.split())}" for p, k in zip(at, keys, strict=True))
        share = f"list_sum(list_transform(range(0, {len(wanted)}), lambda j: case when s + j >= 1 and w[greatest(s + j, 1)] = {_list(wanted)}[j + 1] then 1 else 0 end)) / {len(wanted)}"
        starts = f"list_transform(list_filter(range(1, len(w) + 1), lambda i: w[i] = '{keys[0].split()[0]}'), lambda i: i - {at[0]})"
        scores.append(f"case when list_has_all(w, {_list(sorted({x for k in keys for x in k.split()}))}) then coalesce(list_max(list_transform({starts}, lambda s: case when {whole} then {share} else 0.0 end)), 0.0) else 0.0 end")
    named = lambda cases: f"array_to_string(list_sort(list_distinct(list_filter([{', '.join(cases)}], lambda x: x is not null))), ',')"
    base = [f"case when len(p{k}) > 0 then '{label}' end" for k, label in enumerate(places)]
    method = [f"case when s{k} >= {license_scan.LEAST} then '{label}' end" for k, (label, _, _) in enumerate(license_scan.TEMPLATES)]
    found = " || ".join(f"p{k}" for k in range(len(places)))
    return f"""with w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w
  from documents),
f as (select doc_id, w, {', '.join(f'{e} as p{k}' for k, e in enumerate(places.values()))}, {', '.join(f'{e} as s{k}' for k, e in enumerate(scores))} from w)
select doc_id, cast(len(w) as bigint) as n_words, cast(len({found}) as bigint) as n_base, cast(list_min({found}) - 1 as bigint) as first_word, cast(list_max({found}) - 1 as bigint) as last_word,
  {named(base)} as base_labels, {named(base + method)} as labels, cast(greatest({', '.join(f's{k}' for k in range(len(scores)))}) as double) as score
from f"""


def oracle_sql() -> dict[str, str]:
    return {"op4_jaccard_join": OP4, "op5_license_scan": _op5()}

"""The registered queries that SQL can express, for DuckDB."""

from __future__ import annotations

from .url_filter import DEPTH, LEAST_PURITY, MANY_CHILDREN, PRIOR, PRIOR_WEIGHT, RARE_SHARE, RULES, Z

MIXING = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(coalesce(doc_id::varchar, '') || ':42:' || coalesce(text, '')) as draw from documents),
s as (select source, sum(size)::bigint as n, row_number() over (order by source nulls last) - 1 as i from d group by source),
w as (select source, n, i, case i % 3 when 0 then 3.0 when 1 then 1.0 else 2.0 end::double as wt, 2.0::double * n as cap from s),
r as (select *, row_number() over o as k, sum(cap) over o as caps, sum(wt) over o as wts, sum(wt) over () as wall, 1.5::double * sum(n) over () as total from w window o as (order by cap / wt, i)),
f as (select min(k) as k0 from r where (total - caps + cap) * wt / (wall - wts + wt) <= cap),
z as (select (total - caps + cap) as rest, wall - wts + wt as share from r, f where k = k0),
t as (select source, n, case when k < k0 then cap else (select rest from z) * wt / (select share from z) end as target from r, f),
q as (select *, case when n > 0 then floor(target / n) else 0 end as whole from t)
select doc_id, size, n as source_size, target,
 (size * (whole + case when sum(size) over (partition by d.source order by draw rows between unbounded preceding and current row) - size / 2 <= target - whole * n then 1 else 0 end))::bigint as taken
from d join q on d.source is not distinct from q.source
"""

#: All pairs of a label and the closure of their links: for small tables only.
EMBEDDING_DEDUP = """
with recursive v as materialized (select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: x::double) as vec from embeddings),
ok as materialized (select * from v where vec_id is not null and label is not null and len(vec) > 0
 and len(list_filter(vec, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(vec, lambda x: x <> 0)) > 0),
links as materialized (select a.r as a, b.r as b from ok a join ok b on a.label = b.label and len(a.vec) = len(b.vec) and a.r <> b.r where list_cosine_similarity(a.vec, b.vec) >= 0.98),
reach as (select r as a, r as b from ok union select reach.a, links.b from reach join links on links.a = reach.b),
low as (select reach.a as r, min(v.vec_id) as component_id from reach join v on v.r = reach.b group by reach.a),
n as (select a as r, count(*) as n from links group by a)
select vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, coalesce(vec_id = coalesce(component_id, vec_id), false) as kept
from v left join low using (r) left join n using (r)
"""


def _levels() -> str:
    """The template tree, level by level: rare children of crowded nodes become ``*``."""
    out = ""
    for i in range(DEPTH):
        out += f"""
s{i} as (select *, parts[{i + 1}] as seg from t{i}),
c{i} as (select host, node, seg, sum(n) as c from s{i} where seg is not null group by all),
k{i} as (select host, node, sum(c) as every from c{i} group by all having count(*) > {MANY_CHILDREN}),
q{i} as (select host, node, seg, true as rare from c{i} join k{i} using (host, node) where c < {RARE_SHARE} * every),
t{i + 1} as (select host, parts, n, good, bad, case when seg is null then node else list_append(node, case when rare then '*' else seg end) end as node
 from s{i} left join q{i} using (host, node, seg)),"""
    return out


def _purities() -> str:
    """From the root down: each node's prior, its purity, and what stands behind the priors of its children."""
    out = f"b0 as (select host, node, s, k, {PRIOR}::double as behind, g + b > 0 as host_known from every where len(node) = 0),"
    for i in range(1, DEPTH + 1):
        out += f"""
h{i} as (select every.*, (p.s - case when mg + mb > 0 then mg / (mg + mb) else 0 end + {PRIOR_WEIGHT} * behind) / (p.k - (g + b > 0)::int + {PRIOR_WEIGHT}) as prior, host_known
 from every join b{i - 1} p on every.host = p.host and every.node[:{i - 1}] = p.node where len(every.node) = {i}),
b{i} as (select host, node, s, k, (mg - g + {PRIOR_WEIGHT} * prior) / (mg - g + mb - b + {PRIOR_WEIGHT}) as behind, host_known from h{i}),"""
    rows = " union all ".join(f"select * from h{i}" for i in range(1, DEPTH + 1))
    return out + f"""
purities as (select host, node, (mg + {PRIOR_WEIGHT} * prior) / (mg + mb + {PRIOR_WEIGHT}) as purity, case when g + b > 0 then 'template' when host_known then 'branch' else 'none' end as evidence from ({rows})),"""


def _rules() -> str:
    rows = []
    for rule, verdict in RULES:
        host, _, rest = rule.partition("/")
        rows.append(f"('{rule}', '{verdict}', '{host}', '/{rest}')")
    return ", ".join(rows)


URL_FILTER = rf"""
with u as materialized (select row_number() over () as r, page_id, case when instr(url, '://') > 0 then substring(url, instr(url, '://') + 3) end as rest from pages),
w as (select r, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
rules(rule, verdict, rule_host, start) as (values {_rules()}),
best as (select r, rule, verdict from w join rules on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, start)
 qualify row_number() over (partition by r order by length(rule) desc, verdict desc, rule desc) = 1),
p as (select w.*, rule, verdict, list_transform(string_split(regexp_replace(path, '^/', ''), '/'),
 lambda s: case when regexp_matches(s, '(?i)^([0-9a-f]{{8,}}|[0-9a-f-]{{32,36}})$') and regexp_matches(s, '[0-9]') then '{{hash}}' else regexp_replace(s, '[0-9]+', '#', 'g') end) as shaped
 from w left join best using (r)),
j as materialized (select * exclude (shaped), case when len(shaped) > {DEPTH} then list_append(shaped[1:{DEPTH - 1}], array_to_string(shaped[{DEPTH}:], '/')) else shaped end as parts from p),
t0 as (select host, parts, count(*) as n, count(*) filter (verdict = 'allow') as good, count(*) filter (verdict = 'block') as bad, []::varchar[] as node from j group by host, parts),{_levels()}
leaves as materialized (select * from t{DEPTH}),
up as (select host, good, bad, node, unnest(range(0, len(node) + 1)) as l from leaves),
nodes as materialized (select host, case when l = 0 then []::varchar[] else node[:l] end as node, sum(good)::bigint as g, sum(bad)::bigint as b from up group by all),
kin as (select *, node[:len(node) - 1] as parent from nodes where len(node) > 0 and g + b > 0),
beside as (select *, lag(g) over o as pg, lag(b) over o as pb, g + b as n, lag(g) over o + lag(b) over o as m from kin window o as (partition by host, parent order by b / (g + b), node)),
apart as (select *, coalesce(abs(b / n - pb / m) > {Z} * sqrt((b + pb) / (n + m) * (1 - (b + pb) / (n + m)) * (1 / n + 1 / m)), false)::int as gap from beside),
branches as (select *, sum(gap) over (partition by host, parent order by b / n, node rows between unbounded preceding and current row) as branch from apart),
merged as materialized (select host, node, parent, sum(g) over h as mg, sum(b) over h as mb from branches window h as (partition by host, parent, branch)),
kids as (select host, parent as node, sum(mg / (mg + mb)) as s, count(*) as k from merged group by all),
every as materialized (select n.host, n.node, g, b, coalesce(s, 0) as s, coalesce(k, 0) as k, coalesce(mg, 0) as mg, coalesce(mb, 0) as mb
 from nodes n left join kids on n.host = kids.host and n.node = kids.node left join merged on n.host = merged.host and n.node = merged.node),
{_purities()}
judged as (select l.host, l.parts, purity, evidence from leaves l join purities p on l.host = p.host and l.node = p.node)
select page_id, host, path, rule, coalesce(verdict, case when purity < {LEAST_PURITY} then 'block' else 'allow' end) as verdict, purity, case when rule is not null then 'rule' else evidence end as decided_by
from j left join judged using (host, parts)
"""

"""DuckDB SQL for the rows of `url_filter.filter_urls`, from the same fixed values, unrolled over the depth of the tree."""

from __future__ import annotations

from brightwater.llm.url_filter import DEPTH, FAN_OUT, LONG, REJECT, RULES, SAME_BELOW

_SIDE = (
    "CASE WHEN sum(allowed) = 0 AND sum(unlabelled) = 0 THEN 'block' WHEN sum(blocked) = 0 AND sum(unlabelled) = 0 THEN 'allow'"
    " WHEN sum(blocked) = 0 AND sum(allowed) = 0 THEN 'none' ELSE 'mixed' END AS side"
)
_KINDS = ["blocked", "allowed", "unlabelled"]


def _rule(value) -> str:
    cases = " ".join(
        f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{prefix}') THEN '{value(verdict, host, prefix)}'"
        for verdict, host, prefix in sorted(reversed(RULES), key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {cases} END"


def _level(d: int) -> str:
    """The tree with one more segment generalised."""
    return f"""
    t{d} AS (SELECT *, CASE WHEN len(template) > {d} THEN template[{d + 1}] END AS segment FROM g{d}),
    c{d} AS (SELECT host, general, segment, {_SIDE} FROM t{d} WHERE segment IS NOT NULL GROUP BY host, general, segment),
    w{d} AS (SELECT host, general, side FROM c{d} WHERE side <> 'mixed' GROUP BY host, general, side HAVING count(*) > {FAN_OUT}),
    f{d} AS (SELECT host, general, segment, '*/' || side AS wildcard FROM c{d} JOIN w{d} USING (host, general, side)),
    g{d + 1} AS (
        SELECT host, template, blocked, allowed, unlabelled,
            CASE WHEN segment IS NULL THEN general ELSE list_append(general, coalesce(wildcard, segment)) END AS general
        FROM t{d} LEFT JOIN f{d} USING (host, general, segment)
    ),"""


_CHI = " + ".join(
    f"coalesce(pow({k} * n_before - {k}_before * n, 2) / nullif(({k} + {k}_before) * n * n_before, 0), 0)" for k in _KINDS
)
_SIBLINGS = "PARTITION BY host, parent, level, side ORDER BY blocked / n, allowed / n, general"

SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
parted AS (
    SELECT page_id,
        translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*(/[^?#]*)?', 1) AS path
    FROM cut
),
shaped AS (
    SELECT *, {_rule(lambda verdict, host, prefix: host + prefix)} AS rule, {_rule(lambda verdict, *_: verdict)} AS label,
        [CASE WHEN regexp_matches(s, '[0-9]') OR length(s) > {LONG} THEN '*' || regexp_extract(s, '(\\.[A-Za-z]{{1,5}})?$', 1) ELSE s END
            FOR s IN string_split(path, '/') IF s <> ''] AS whole
    FROM parted
),
marked AS (
    SELECT page_id, host, path, rule, label,
        CASE WHEN len(whole) > {DEPTH} THEN list_append(whole[1:{DEPTH}], '**') ELSE whole END AS template
    FROM shaped
),
g0 AS (
    SELECT host, template, count(*) FILTER (label = 'block') AS blocked, count(*) FILTER (label = 'allow') AS allowed,
        count(*) FILTER (label IS NULL) AS unlabelled, CAST([] AS VARCHAR[]) AS general
    FROM marked GROUP BY host, template
),{"".join(_level(d) for d in range(DEPTH + 1))}
nodes AS (
    SELECT host, general, general[1:greatest(len(general) - 1, 0)] AS parent, len(general) AS level, {_SIDE},
        {", ".join(f"CAST(sum({k}) AS DOUBLE) AS {k}" for k in _KINDS)}, CAST(sum(blocked + allowed + unlabelled) AS DOUBLE) AS n
    FROM g{DEPTH + 1} GROUP BY host, general
),
compared AS (
    SELECT *, {", ".join(f"lag({k}) OVER s AS {k}_before" for k in [*_KINDS, "n"])} FROM nodes WINDOW s AS ({_SIBLINGS})
),
tested AS (SELECT *, CASE WHEN n_before IS NOT NULL AND {_CHI} <= {SAME_BELOW} THEN 0 ELSE 1 END AS new FROM compared),
branches AS (SELECT *, sum(new) OVER ({_SIBLINGS}) AS branch FROM tested),
judged AS (
    SELECT host, general, (sum(blocked) OVER b + 1) / (sum(blocked) OVER b + sum(allowed) OVER b + 2) AS purity
    FROM branches WINDOW b AS (PARTITION BY host, parent, level, side, branch)
)
SELECT page_id, host, path, rule, coalesce(label, CASE WHEN purity >= {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
    '/' || array_to_string(general, '/') AS template, purity
FROM marked JOIN g{DEPTH + 1} USING (host, template) JOIN judged USING (host, general)
"""

"""DuckDB oracle SQL for the keyed-diff and nested-diff keys.

Written independently of the Spark operators: the derivations of
``bindings.py`` and the comparison rules, expressed with DuckDB list
lambdas. Helpers below only assemble SQL text.
"""

from __future__ import annotations

KIND_LIST = "['func','method','struct','interface','type alias','type','const','var']"
CHANGE_LIST = "['added','removed','modified','renamed']"
PT = "STRUCT(name VARCHAR, type VARCHAR)[]"
FT = "STRUCT(name VARCHAR, type VARCHAR, doc VARCHAR)[]"


def part_rows_sql(side: str) -> str:
    if side == "old":
        return """SELECT p_brand AS scope, 'Sym' || p_partkey AS name, CAST(p_partkey % 8 AS INTEGER) AS kind,
                  p_type AS ptype, p_size AS psize, p_partkey AS ordinal
           FROM part WHERE p_partkey % 10 <> 0"""
    return """SELECT p_brand AS scope,
                  CASE WHEN p_partkey % 10 = 3 THEN 'New' || p_partkey ELSE 'Sym' || p_partkey END AS name,
                  CAST(p_partkey % 8 AS INTEGER) AS kind, p_type AS ptype,
                  CASE WHEN p_partkey % 10 = 2 THEN p_size + 1 ELSE p_size END AS psize, p_partkey AS ordinal
           FROM part WHERE p_partkey % 10 <> 1"""


def symbols_sql(side: str) -> str:
    k = "p_partkey"
    ko = f"CAST({k} % 8 AS INTEGER)"
    if side == "old":
        where = f"{k} % 10 <> 0"
        v = "CAST(p_size AS VARCHAR)"
        name = f"'Sym' || {k}"
        kind = f"{KIND_LIST}[{ko} + 1]"
        recv_n = f"{k} % 3"
    else:
        where = f"{k} % 10 <> 1"
        v = f"CAST(CASE WHEN {k} % 10 = 2 THEN p_size + 1 ELSE p_size END AS VARCHAR)"
        name = f"CASE WHEN {k} % 10 = 3 THEN 'New' || {k} ELSE 'Sym' || {k} END"
        kind = f"CASE WHEN {ko} = 6 AND {k} % 10 = 2 THEN 'var' ELSE {KIND_LIST}[{ko} + 1] END"
        recv_n = f"({k} + CASE WHEN {k} % 10 = 2 THEN 1 ELSE 0 END) % 3"
    recv = f"CASE WHEN {ko} = 1 THEN 'T' || CAST({recv_n} AS VARCHAR) ELSE '' END"
    return f"""
      SELECT repo, path, ordinal, name, kind,
        CASE WHEN ko = 0 THEN 'func ' || name || '(p' || v || ' int) error'
             WHEN ko = 1 THEN 'func (' || recv || ') ' || name || '(string) (n' || v || ' int)'
             WHEN ko = 2 THEN 'type ' || name || ' struct{{Size int; Tag' || v || ' string}}'
             WHEN ko = 3 THEN 'type ' || name || ' interface{{Get() int; Len() [' || v || ']int}}'
             WHEN ko = 4 THEN 'type ' || name || ' = [' || v || ']byte'
             WHEN ko = 5 THEN 'type ' || name || ' [' || v || ']byte'
             WHEN kind = 'const' THEN 'const ' || name
             ELSE 'var ' || name || ' [' || v || ']int' END AS signature,
        doc, recv,
        CASE WHEN ko = 0 THEN [{{'name': 'p' || v, 'type': 'int'}}]::{PT}
             WHEN ko = 1 THEN [{{'name': '', 'type': 'string'}}]::{PT}
             ELSE []::{PT} END AS params,
        CASE WHEN ko = 0 THEN [{{'name': '', 'type': 'error'}}]::{PT}
             WHEN ko = 1 THEN [{{'name': 'n' || v, 'type': 'int'}}]::{PT}
             ELSE []::{PT} END AS returns,
        CASE WHEN ko = 2 THEN [{{'name': 'Size', 'type': 'int', 'doc': ''}}, {{'name': 'Tag' || v, 'type': 'string', 'doc': ''}}]::{FT}
             ELSE []::{FT} END AS fields,
        CASE WHEN ko = 3 THEN [{{'name': 'Get', 'type': 'func() int', 'doc': ''}}, {{'name': 'Len', 'type': 'func() [' || v || ']int', 'doc': ''}}]::{FT}
             ELSE []::{FT} END AS methods,
        '' AS grp
      FROM (
        SELECT p_type AS repo, p_brand || '.go' AS path, CAST({k} AS INTEGER) AS ordinal,
               {name} AS name, {kind} AS kind, {ko} AS ko, {v} AS v, {recv} AS recv, p_name AS doc
        FROM part WHERE {where}
      )"""


# --- comparison rules as DuckDB expressions --------------------------------


def fmt_param(x: str) -> str:
    return f"(CASE WHEN {x}.name <> '' THEN {x}.name || ' ' || {x}.type ELSE {x}.type END)"


def pkey(x: str) -> str:
    return f"(CASE WHEN {x}.name <> '' THEN {x}.name ELSE ':' || {x}.type END)"


def fmt_list(a: str) -> str:
    return f"array_to_string(list_transform({a}, lambda q: {fmt_param('q')}), ', ')"


def cat(*lists: str) -> str:
    out = lists[0]
    for x in lists[1:]:
        out = f"list_concat({out}, {x})"
    return out


E = "[]::VARCHAR[]"


def cmp_kind(o: str, n: str) -> str:
    return f"(CASE WHEN {o} <> {n} THEN ['kind changed from ' || {o} || ' to ' || {n}] ELSE {E} END)"


def cmp_params(o: str, n: str) -> str:
    added = (f"list_transform(list_filter({n}, lambda x: len(list_filter({o}, lambda y: {pkey('y')} = {pkey('x')})) = 0), "
             f"lambda x: 'parameter ' || {fmt_param('x')} || ' added')")
    removed = (f"list_transform(list_filter({o}, lambda x: len(list_filter({n}, lambda y: {pkey('y')} = {pkey('x')})) = 0), "
               f"lambda x: 'parameter ' || {fmt_param('x')} || ' removed')")
    retyped = (f"flatten(list_transform(list_filter({o}, lambda x: x.name <> ''), lambda x: "
               f"list_transform(list_filter({n}, lambda y: y.name = x.name AND y.type <> x.type), "
               f"lambda y: 'parameter ' || x.name || ' type changed from ' || x.type || ' to ' || y.type)))")
    found = cat(added, removed, retyped)
    positional = (f"list_filter(list_transform(generate_series(1, len({o})), lambda i: CASE WHEN "
                  f"{o}[i].name <> {n}[i].name OR {o}[i].type <> {n}[i].type THEN 'parameter at position ' || "
                  f"CAST(i - 1 AS VARCHAR) || ' changed from ' || {fmt_param(o + '[i]')} || ' to ' || "
                  f"{fmt_param(n + '[i]')} END), lambda s: s IS NOT NULL)")
    return f"(CASE WHEN len({o}) = len({n}) AND len({found}) = 0 THEN {positional} ELSE {found} END)"


def cmp_returns(o: str, n: str) -> str:
    per = (f"flatten(list_transform(generate_series(1, len({o})), lambda i: list_filter(["
           f"CASE WHEN {o}[i].type <> {n}[i].type THEN 'return value at position ' || CAST(i - 1 AS VARCHAR) || "
           f"' type changed from ' || {o}[i].type || ' to ' || {n}[i].type END, "
           f"CASE WHEN {o}[i].name <> {n}[i].name THEN 'return value at position ' || CAST(i - 1 AS VARCHAR) || "
           f"' name changed from ' || {o}[i].name || ' to ' || {n}[i].name END], lambda s: s IS NOT NULL)))")
    cnt = f"['return values changed from (' || {fmt_list(o)} || ') to (' || {fmt_list(n)} || ')']"
    return f"(CASE WHEN len({o}) <> len({n}) THEN {cnt} ELSE {per} END)"


def cmp_members(o: str, n: str, noun: str, changed: str) -> str:
    added = (f"list_transform(list_filter({n}, lambda x: len(list_filter({o}, lambda y: y.name = x.name)) = 0), "
             f"lambda x: '{noun} ' || x.name || ' ' || x.type || ' added')")
    removed = (f"list_transform(list_filter({o}, lambda x: len(list_filter({n}, lambda y: y.name = x.name)) = 0), "
               f"lambda x: '{noun} ' || x.name || ' ' || x.type || ' removed')")
    last = f"list_filter({n}, lambda y: y.name = x.name)[-1]"
    retyped = (f"list_transform(list_filter({o}, lambda x: len(list_filter({n}, lambda y: y.name = x.name)) > 0 "
               f"AND x.type <> {last}.type), lambda x: '{noun} ' || x.name || ' {changed} from ' || x.type || "
               f"' to ' || {last}.type)")
    return cat(added, removed, retyped)


def cmp_fields(o: str, n: str) -> str:
    return cmp_members(o, n, "field", "type changed")


def cmp_methods(o: str, n: str) -> str:
    return cmp_members(o, n, "method", "signature changed")


def cmp_receiver(o: str, n: str) -> str:
    return f"(CASE WHEN {o} <> {n} THEN ['receiver changed from ' || {o} || ' to ' || {n}] ELSE {E} END)"


def go_quote(x: str) -> str:
    s = f"replace(replace(replace(replace(replace({x}, '\\', '\\\\'), '\"', '\\\"'), chr(10), '\\n'), chr(9), '\\t'), chr(13), '\\r')"
    return f"('\"' || {s} || '\"')"


def compare_all(o: str = "o_", n: str = "n_") -> str:
    found = cat(
        cmp_kind(o + "kind", n + "kind"),
        cmp_params(o + "params", n + "params"),
        cmp_returns(o + "returns", n + "returns"),
        cmp_fields(o + "fields", n + "fields"),
        cmp_methods(o + "methods", n + "methods"),
        cmp_receiver(o + "recv", n + "recv"),
    )
    sig = (f"(CASE WHEN len({found}) = 0 AND {o}signature <> {n}signature THEN ['signature changed from ' || "
           f"{go_quote(o + 'signature')} || ' to ' || {go_quote(n + 'signature')}] ELSE {E} END)")
    return cat(found, sig)


def shape_json(p: str = "") -> str:
    """The rename shape as the same compact JSON text Spark's ``to_json`` gives."""
    return (
        f"'{{\"k\":\"' || {p}kind || '\",\"r\":\"' || {p}recv || '\",\"p\":[' || "
        f"array_to_string(list_transform({p}params, lambda q: '\"' || q.type || '\"'), ',') || '],\"q\":[' || "
        f"array_to_string(list_transform({p}returns, lambda q: '\"' || q.type || '\"'), ',') || '],\"f\":[' || "
        f"array_to_string(list_transform({p}fields, lambda q: '{{\"n\":\"' || q.name || '\",\"t\":\"' || q.type || '\"}}'), ',') || ']}}'"
    )


SYM_COLS = ["kind", "signature", "recv", "params", "returns", "fields", "methods"]


def joined_sql() -> str:
    """CTEs o, n (last wins), j (full outer join with o_/n_ columns)."""
    oc = ", ".join(f"o.{c} AS o_{c}" for c in SYM_COLS)
    nc = ", ".join(f"n.{c} AS n_{c}" for c in SYM_COLS)
    return f"""
    so AS ({symbols_sql('old')}),
    sn AS ({symbols_sql('new')}),
    o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY ordinal DESC) AS rn_ FROM so) WHERE rn_ = 1),
    n AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, path, name ORDER BY ordinal DESC) AS rn_ FROM sn) WHERE rn_ = 1),
    j AS (
      SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.path, n.path) AS path, coalesce(o.name, n.name) AS name,
             o.name IS NOT NULL AS has_o, n.name IS NOT NULL AS has_n, {oc}, {nc}
      FROM o FULL OUTER JOIN n ON o.repo = n.repo AND o.path = n.path AND o.name = n.name
    )"""


def diffs_sql(renames: bool = True, apart: str = "false") -> str:
    """CTE chain ending in ``d`` with the symbol diff rows (flat text); rows
    that are ``apart`` are not paired as renames."""
    base = joined_sql() + f""",
    c AS (SELECT *, {compare_all()} AS ch FROM j WHERE has_o AND has_n),
    d0 AS (
      SELECT repo, path, name, '' AS old_name, 0 AS change_ord, n_kind AS kind, n_signature AS signature,
             '' AS old_signature, {E} AS ch, sha256({shape_json('n_')}) AS shape FROM j WHERE NOT has_o
      UNION ALL
      SELECT repo, path, name, '', 1, o_kind, o_signature, o_signature, {E}, sha256({shape_json('o_')}) FROM j WHERE NOT has_n
      UNION ALL
      SELECT repo, path, name, '', 2, n_kind, n_signature, o_signature, ch, NULL FROM c WHERE len(ch) > 0
    )"""
    if not renames:
        return base + ", d AS (SELECT * FROM d0)"
    return base + f""",
    cand AS (SELECT *, CASE WHEN NOT ({apart}) THEN row_number() OVER (PARTITION BY repo, path, shape, change_ord, {apart} ORDER BY name) END AS rn
             FROM d0 WHERE change_ord < 2),
    pairs AS (
      SELECT a.repo, a.path, a.name, r.name AS old_name, 3 AS change_ord, a.kind, a.signature,
             r.old_signature, a.ch, a.shape, r.name AS r_name
      FROM cand a JOIN cand r ON a.repo = r.repo AND a.path = r.path AND a.shape = r.shape AND a.rn = r.rn
      WHERE a.change_ord = 0 AND r.change_ord = 1
    ),
    d AS (
      SELECT repo, path, name, old_name, change_ord, kind, signature, old_signature, ch, shape FROM d0 WHERE change_ord = 2
      UNION ALL SELECT repo, path, name, old_name, change_ord, kind, signature, old_signature, ch, shape FROM pairs
      UNION ALL SELECT repo, path, name, old_name, change_ord, kind, signature, old_signature, ch, shape FROM cand c
        WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repo = c.repo AND p.path = c.path
                          AND ((c.change_ord = 0 AND p.name = c.name) OR (c.change_ord = 1 AND p.r_name = c.name)))
    )"""


DIFF_SELECT = f"""SELECT repo, path, name, old_name, {CHANGE_LIST}[change_ord + 1] AS change, change_ord, kind, signature,
       old_signature, array_to_string(ch, chr(10)) AS changes FROM d"""

"""DuckDB SQL of the graph and of kernel features, built from parts; the oracle side of the kernel queries."""

from __future__ import annotations

from ..functions.hashing import sql_hash_list, sql_hash_string

BASE = """n AS (SELECT n_regionkey::VARCHAR AS ex, n_nationkey::VARCHAR AS id, n_name AS name FROM nation),
s AS (SELECT n.ex, s_suppkey::VARCHAR AS id, CASE WHEN s_acctbal >= 5000 THEN 'high' ELSE 'low' END AS band, s_acctbal AS balance, n.id AS nation FROM supplier JOIN n ON n.id = s_nationkey::VARCHAR),
c AS (SELECT n.ex, c_custkey::VARCHAR AS id, c_mktsegment AS segment, n.id AS nation FROM customer JOIN n ON n.id = c_nationkey::VARCHAR),
sends_back AS (SELECT DISTINCT c.ex, c.id AS customer, s.id AS supplier FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN c ON c.id = o_custkey::VARCHAR JOIN s ON s.id = l_suppkey::VARCHAR
  WHERE o_orderpriority = '1-URGENT' AND l_returnflag = 'R' AND c.ex = s.ex)"""


def graph_sql(trade: bool = False) -> str:
    """CTEs up to v (vertices) and e (edges, both directions)."""
    vertex = "SELECT ex, ex || '/{sig}/' || {ids} AS vid, '{sig}' AS sig, '{kind}' AS kind, {sym} AS sym_id, [{syms}] AS syms, {nums} AS nums, {kp} AS is_kp FROM {table}"

    def entity(sig: str, table: str, syms: str, nums: str = "[]::DOUBLE[]") -> str:
        return vertex.format(sig=sig, ids="id", kind="i", sym="id", syms=f"'{sig}', {syms}", nums=nums, kp="true", table=table)

    def relation(sig: str, table: str, a: str, b: str) -> str:
        return vertex.format(sig=sig, ids=f"{a} || '/' || {b}", kind="r", sym=f"'{sig}' || {a} || {b}", syms=f"'{sig}'", nums="[]::DOUBLE[]", kp="false", table=table)

    def ends(sig: str, table: str, a: str, b: str, ends: tuple[tuple[str, str, str], ...]) -> list[str]:
        return [f"SELECT ex, ex || '/{sig}/' || {a} || '/' || {b} AS r, ex || '/{entity}/' || {column} AS i, '{role}' AS role FROM {table}" for column, entity, role in ends]

    v = [entity("nation", "n", "name"), entity("supplier", "s", "band", "[balance]"), relation("supp_in", "s", "id", "nation")]
    half = ends("supp_in", "s", "id", "nation", (("id", "supplier", "p1"), ("nation", "nation", "p0")))
    if trade:
        v += [entity("customer", "c", "segment"), relation("cust_in", "c", "id", "nation"), relation("sends_back", "sends_back", "customer", "supplier")]
        half += ends("cust_in", "c", "id", "nation", (("id", "customer", "p1"), ("nation", "nation", "p0")))
        half += ends("sends_back", "sends_back", "customer", "supplier", (("customer", "customer", "buyer"), ("supplier", "supplier", "seller")))
    return f"{BASE},\nv AS ({' UNION ALL '.join(v)}),\nhalf AS ({' UNION ALL '.join(half)}),\ne AS (SELECT ex, r AS src, i AS dst, role FROM half UNION ALL SELECT ex, i, r, role FROM half)"


def _attributes(rows: str, label: str) -> str:
    """(g, vid, pred, bin, w) of rows (g, vid, label, syms, nums)."""
    symbols = f"SELECT g, vid, {sql_hash_string(f"('pred:' || {label})")} AS pred, {sql_hash_string("('bin:' || (k - 1) || '_v:' || x)")} AS bin, 1.0::DOUBLE AS w FROM (SELECT *, unnest(syms) AS x, generate_subscripts(syms, 1) AS k FROM ({rows}))"
    numbers = f"SELECT g, vid, {sql_hash_string(f"('f:' || {label})")}, {sql_hash_string("('bn:' || (k - 1))")}, x FROM (SELECT *, unnest(nums) AS x, generate_subscripts(nums, 1) AS k FROM ({rows}))"
    return f"{symbols} UNION ALL {numbers}"


def hist_sql(match_type: str = "hard", radius: int = 0, distance: int = 0, variant: str = "nspdk", normalization: bool = True, min_kernel: bool = False) -> str:
    """CTEs up to h (case_id, rd, key, pred, bin, w) for cases that are the suppliers."""
    hard = match_type == "hard"
    plain = "array_to_string(syms, '.')" if hard else "sig"
    ctes = [graph_sql(), "d1 AS (SELECT DISTINCT ex, src, dst FROM e)", "d2 AS (SELECT DISTINCT a.ex, a.src, b.dst FROM d1 a JOIN d1 b ON a.dst = b.src)", "d3 AS (SELECT DISTINCT a.ex, a.src, b.dst FROM d2 a JOIN d1 b ON a.dst = b.src)", "d4 AS (SELECT DISTINCT a.ex, a.src, b.dst FROM d3 a JOIN d1 b ON a.dst = b.src)", "d5 AS (SELECT DISTINCT a.ex, a.src, b.dst FROM d4 a JOIN d1 b ON a.dst = b.src)"]
    if variant == "rnspdk":
        steps = " UNION ALL ".join(["SELECT ex, vid AS src, vid AS dst FROM v", *[f"SELECT ex, src, dst FROM d{k}" for k in range(1, min(5, 2 * radius + distance + 1) + 1)]])
        mark = "viewpoint." if hard else "viewpoint"
        ctes.append(f"near AS (SELECT DISTINCT src AS g, dst AS vid FROM ({steps}) WHERE src LIKE '%/supplier/%')")
        ctes.append(f"lv AS (SELECT near.g, v.vid, CASE WHEN near.g = v.vid THEN '{mark}' || {plain} ELSE {plain} END AS label, sig, syms, nums, is_kp FROM v JOIN near ON near.vid = v.vid)")
        ctes.append("le AS (SELECT a.g, e.src, e.dst, e.role FROM e JOIN near a ON a.vid = e.src JOIN near b ON b.vid = e.dst AND b.g = a.g)")
    else:
        ctes.append(f"lv AS (SELECT ex AS g, vid, {plain} AS label, sig, syms, nums, is_kp FROM v)")
        ctes.append("le AS (SELECT ex AS g, src, dst, role FROM e)")
    ctes.append(
        "dist AS (SELECT g, src, dst, min(d) AS d FROM (SELECT g, vid AS src, vid AS dst, 0 AS d FROM lv UNION ALL SELECT DISTINCT g, src, dst, 1 FROM le "
        "UNION ALL SELECT DISTINCT a.g, a.src, b.dst, 2 FROM le a JOIN le b ON a.g = b.g AND a.dst = b.src) GROUP BY 1, 2, 3)"
    )
    child = "SELECT le.g, le.src AS vid, list_sort(list(c.label || '-' || le.role)) AS k FROM le JOIN lv c ON c.g = le.g AND c.vid = le.dst GROUP BY 1, 2"
    zero = f"SELECT g, vid, @r AS r, {sql_hash_string('label')} AS code FROM lv"
    one = f"SELECT lv.g, lv.vid, 1 AS r, {sql_hash_string("(label || ':' || array_to_string(coalesce(k, []), '.'))")} AS code FROM lv LEFT JOIN ({child}) x ON x.g = lv.g AND x.vid = lv.vid"
    codes = [zero.replace("@r", str(r)) if r == 0 or match_type == "soft" else one for r in range(radius + 1)]
    ctes.append(f"code AS ({' UNION ALL '.join(codes)})")
    if match_type in ("soft", "mixed"):
        ball = "SELECT dist.g, dist.src AS vid, lv.label, lv.syms, lv.nums FROM dist JOIN lv ON lv.g = dist.g AND lv.vid = dist.dst WHERE d <= 2"
        forms = {
            0: _attributes("SELECT g, vid, label, syms, nums FROM lv", "label"),
            1: _attributes("SELECT le.g, le.src AS vid, c.label, c.syms, c.nums FROM le JOIN lv c ON c.g = le.g AND c.vid = le.dst", "label") + " UNION ALL " + _attributes("SELECT g, vid, label || '+r' AS label, syms, nums FROM lv", "label"),
            2: _attributes(ball, "label"),
        }
        parts = [f"SELECT g, vid, {r} AS r, pred, bin, sum(w) AS w FROM ({forms[radius if match_type == 'mixed' else r]}) GROUP BY 1, 2, 4, 5" for r in range(radius + 1)]
        ctes.append(f"soft AS ({' UNION ALL '.join(parts)})")
    else:
        ctes.append("soft AS (SELECT g, vid, r, 1::BIGINT AS pred, 1::BIGINT AS bin, 1.0::DOUBLE AS w FROM code)")
    own = "s.vid" if variant == "rnspdk" else "s.ex"
    low, high = "least(a.code, b.code)", "greatest(a.code, b.code)"
    pair = sql_hash_list(f"[{low}, {high}]")
    key = {"mnspdk": pair, "alnspdk": f"CASE WHEN d = 0 THEN {sql_hash_list('[a.code]')} ELSE {sql_hash_list('[a.code, b.code]')} END"}.get(variant, f"CASE WHEN d = 0 THEN {sql_hash_list('[a.code]')} ELSE {pair} END")
    rd = sql_hash_list("[a.r]") if variant == "gnspdk" else sql_hash_list("[d, a.r]")
    ctes.append(
        f"pairs AS (SELECT s.vid AS case_id, dist.g, a.r, d, {rd} AS rd, {key} AS key, {sql_hash_list('[b.code]')} AS far_key, {sql_hash_list('[1, d, a.r]')} AS far_rd, dist.src AS s, dist.dst AS t "
        f"FROM v s JOIN dist ON dist.g = {own} AND dist.src = s.vid AND d <= {distance} JOIN lv k ON k.g = dist.g AND k.vid = dist.dst AND k.is_kp "
        "JOIN code a ON a.g = dist.g AND a.vid = dist.src JOIN code b ON b.g = dist.g AND b.vid = dist.dst AND b.r = a.r WHERE s.sig = 'supplier')"
    )
    if variant == "gnspdk":
        ctes.append("top AS (SELECT case_id, r, max(d) AS m FROM pairs GROUP BY 1, 2)")
    source = "pairs JOIN top USING (case_id, r)" if variant == "gnspdk" else "pairs"
    limit = "d = m" if variant == "gnspdk" else "true"
    doubled = "true" if variant == "mnspdk" else "d > 0"
    ends = [f"SELECT case_id, g, r, rd, key, s AS vid FROM {source} WHERE {limit}", f"SELECT case_id, g, r, rd, key, t FROM {source} WHERE {limit} AND {doubled}"]
    if variant == "alnspdk":
        ends.append("SELECT case_id, g, r, far_rd, far_key, t FROM pairs WHERE d > 0")
    ctes.append(f"ends AS ({' UNION ALL '.join(ends)})")
    ctes.append("h AS (SELECT case_id, rd, key, pred, bin, sum(w) AS w FROM ends JOIN soft ON soft.g = ends.g AND soft.vid = ends.vid AND soft.r = ends.r GROUP BY 1, 2, 3, 4, 5)")
    return ",\n".join(ctes)


def features_sql(cte: bool = False, **options) -> str:
    """The query of features (case_id, feature, value), or its CTEs up to f."""
    parts = hist_sql(**options)
    order = "rd, key, pred, bin"
    if options.get("min_kernel"):
        f = f"SELECT DISTINCT case_id, {sql_hash_list(f'[{order}, z]')} AS feature, 1.0::DOUBLE AS value FROM (SELECT *, unnest(range(0, ceil(w)::BIGINT)) AS z FROM h WHERE w > 0)"
    else:
        value = "w"
        source = "h"
        if options.get("normalization", True):
            parts += (
                ",\nm3 AS (SELECT case_id, rd, key, pred, sum(w * w) AS n3 FROM h GROUP BY 1, 2, 3, 4),\nm2 AS (SELECT case_id, rd, key, count(*) AS n2 FROM m3 GROUP BY 1, 2, 3),"
                "\nm1 AS (SELECT case_id, rd, count(*) AS n1 FROM m2 GROUP BY 1, 2),\nm0 AS (SELECT case_id, count(*) AS n0 FROM m1 GROUP BY 1)"
            )
            value, source = "w / sqrt(n0 * n1 * n2 * n3)", "h JOIN m3 USING (case_id, rd, key, pred) JOIN m2 USING (case_id, rd, key) JOIN m1 USING (case_id, rd) JOIN m0 USING (case_id)"
        f = f"SELECT case_id, feature, arg_max(value, o) AS value FROM (SELECT case_id, {sql_hash_list(f'[{order}, 0]')} AS feature, {value} AS value, [{order}] AS o FROM {source} WHERE w <> 0) GROUP BY 1, 2"
    parts += f",\nf AS ({f})"
    return parts if cte else f"WITH {parts} SELECT case_id, feature, round(value, 6) AS value FROM f"

"""SQL of the queries that SQL can say in full, for one engine with lambdas and sha256."""

from __future__ import annotations

#: Levels that the SQL of the manifest spells out: enough for 8 ** TREE_LEVELS rows of a language.
TREE_LEVELS, TOP_LEVELS = 7, 2


def _field(name: str) -> str:
    return f"coalesce(strlen(CAST({name} AS VARCHAR)) || ':' || CAST({name} AS VARCHAR), '-')"


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit with the reversed polynomial 0xEDB88320."""
    bits = "list_reduce([CAST(b AS UBIGINT) FOR b IN range(8)], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(c, ch))"
    return f"xor(list_reduce([CAST(ascii(x) AS UBIGINT) FOR x IN string_split({text}, '')], lambda c, ch: {bits}, CAST(4294967295 AS UBIGINT)), CAST(4294967295 AS UBIGINT))"


def _levels(name: str, count: int) -> list[str]:
    """CTEs name1, name2, ... of nodes over name0 (grp, node, n, h), and name_s1, ... with each node's siblings."""
    out = []
    for k in range(1, count + 1):
        out.append(f"{name}{k} AS (SELECT grp, node // 8 AS node, (max(n) + 7) // 8 AS n, CASE WHEN max(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY node)) END AS h FROM {name}{k - 1} GROUP BY grp, node // 8)")
        out.append(
            f"{name}_s{k} AS (SELECT a.grp, a.node, any_value(a.n) AS n, coalesce(string_agg(b.h, '' ORDER BY b.node) FILTER (b.node < a.node), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.node) FILTER (b.node > a.node), '') AS r"
            f" FROM {name}{k - 1} a JOIN {name}{k - 1} b ON a.grp IS NOT DISTINCT FROM b.grp AND a.node // 8 = b.node // 8 GROUP BY a.grp, a.node)"
        )
    return out


def manifest_sql() -> str:
    plain = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    changed = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", lower))
    parts = [
        f"d AS (SELECT doc_id, lang AS grp, sha256({plain}) AS h, CASE WHEN {_crc32('CAST(doc_id AS VARCHAR)')} % 3 = 0 THEN sha256({changed}) ELSE sha256({plain}) END AS t FROM documents)",
        "rows_ AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, h) - 1 AS node, count(*) OVER (PARTITION BY grp) AS n FROM d)",
        "t0 AS (SELECT grp, node, n, h FROM rows_)",
        *_levels("t", TREE_LEVELS),
        f"u0 AS (SELECT 0 AS grp, row_number() OVER (ORDER BY grp NULLS FIRST) - 1 AS node, count(*) OVER () AS n, h, grp AS lang FROM t{TREE_LEVELS})",
        *_levels("u", TOP_LEVELS),
        "f0 AS (SELECT r.doc_id, r.grp, r.node, r.h AS leaf, r.t AS f, '' AS proof, u.node AS place, u.h AS subroot FROM rows_ r JOIN u0 u ON r.grp IS NOT DISTINCT FROM u.lang)",
    ]
    for k in range(1, TREE_LEVELS + TOP_LEVELS + 1):
        low = k <= TREE_LEVELS
        steps = f"t_s{k}" if low else f"u_s{k - TREE_LEVELS}"
        on = f"f.grp IS NOT DISTINCT FROM s.grp AND f.node // {8 ** (k - 1)} = s.node" if low else f"f.place // {8 ** (k - 1 - TREE_LEVELS)} = s.node"
        parts.append(f"f{k} AS (SELECT f.doc_id, f.grp, f.node, f.leaf, CASE WHEN s.n = 1 THEN f.f ELSE sha256(s.l || f.f || s.r) END AS f, f.proof || s.l || s.r AS proof, f.place, f.subroot FROM f{k - 1} f JOIN {steps} s ON {on})")
    last = f"f{TREE_LEVELS + TOP_LEVELS}"
    return "WITH " + ", ".join(parts) + f" SELECT doc_id, leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified FROM {last}, u{TOP_LEVELS} r"


def vector_codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd rounds spelled out, one after another, over all vectors and entries."""
    ctes = [
        "kept AS (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS i, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"x AS (SELECT i, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM kept, range({parts}) t(p))",
        f"c0 AS (SELECT p, i - 1 AS e, v FROM x WHERE i <= {entries})",
    ]
    for r in range(rounds + 1):
        distance = "CAST(list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        ctes.append(f"a{r} AS MATERIALIZED (SELECT x.i, x.p, min({{'d': {distance}, 'e': c.e}}) AS m FROM x JOIN c{r} c ON c.p = x.p GROUP BY x.i, x.p)")
        if r < rounds:
            ctes.append(f"s{r} AS (SELECT x.p, a.m.e AS e, g.k AS k, CAST(sum(x.v[g.k + 1]) AS BIGINT) AS s, count(*) AS n FROM a{r} a JOIN x ON x.i = a.i AND x.p = a.p, LATERAL (SELECT unnest(range(len(x.v))) AS k) g GROUP BY x.p, a.m.e, g.k)")
            floor = "(s - ((s % n) + n) % n) // n"
            ctes.append(f"l{r} AS (SELECT p, e, list({floor} ORDER BY k) AS v FROM s{r} GROUP BY p, e)")
            ctes.append(f"c{r + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(l.v, c.v) AS v FROM c{r} c LEFT JOIN l{r} l ON l.p = c.p AND l.e = c.e)")
    ctes += [
        f"coded AS (SELECT i, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY i)",
        f"book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM c{rounds})",
    ]
    return "WITH " + ", ".join(ctes) + " SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, book.h AS codebooks_sha256 FROM kept k JOIN coded c ON c.i = k.i, book"

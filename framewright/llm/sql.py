"""DuckDB SQL that is too long for the table of queries."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

FILTER_AUDIT = f"""
    WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
         firsts AS (SELECT t, min(doc_id) AS first_id FROM d GROUP BY t),
         w AS (SELECT d.*, {_WORDS} AS words, coalesce(doc_id > first_id, false) AS again FROM d JOIN firsts USING (t)),
         f AS (SELECT doc_id, part,
                      (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT
                      + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t))::INT
                      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * again::INT AS mask FROM w),
         l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
         m AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n
               FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
         b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c, unnest([1, 2, 4, 8, 16]) AS bit),
         p AS (SELECT b1.c || b2.c || b3.c || b4.c || b5.c AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits
               FROM b b1, b b2, b b3, b b4, b b5 WHERE len(list_distinct([b1.c, b2.c, b3.c, b4.c, b5.c])) = 5),
         s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before
               FROM p, range(1, 6) AS r(step)),
         x AS (SELECT *, mask & bit <> 0 AS fails, mask & before <> 0 AS earlier FROM m, s),
         g AS (SELECT part, filter_order, step, bit,
                      coalesce(sum(n) FILTER (WHERE NOT fails AND NOT earlier), 0)::BIGINT AS kept,
                      coalesce(sum(n) FILTER (WHERE fails AND NOT earlier), 0)::BIGINT AS removed,
                      coalesce(sum(n) FILTER (WHERE fails AND earlier), 0)::BIGINT AS redundant,
                      coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
                      coalesce(sum(n) FILTER (WHERE fails AND NOT earlier AND good), 0)::BIGINT AS good_lost,
                      coalesce(sum(n) FILTER (WHERE fails AND NOT earlier AND toxic), 0)::BIGINT AS toxic_lost
               FROM x GROUP BY ALL)
    SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
           (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM g"""


def merkle(levels: int = 5, top_levels: int = 4) -> str:
    """Manifest and proofs for up to 16**levels rows of a source and 16**top_levels sources."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    leaf = lambda text: f"sha256({' || '.join(field(c) for c in ('doc_id', 'source', 'lang', 'n_chars', text))})"
    crc = "list_reduce(list_prepend(4294967295, list_transform(range(length(doc_id::VARCHAR)), lambda i: ord((doc_id::VARCHAR)[i + 1]))), lambda c, x: xor(c >> 8, crcs[xor(c, x) % 256 + 1]))"
    parts = [
        "k AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crcs)",
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS cur FROM documents, k)",
        "g AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS gi, count(*) AS n FROM documents GROUP BY source)",
        "a0 AS (SELECT gi AS tree, row_number() OVER (PARTITION BY gi ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, n FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)",
        "p0 AS (SELECT doc_id, leaf, cur, '' AS proof, gi, n, gi AS tree, row_number() OVER (PARTITION BY gi ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source)",
    ]

    def climb(a: str, p: str, n: int, more: str) -> None:
        for k in range(n):
            parts.append(f"r{a}{k} AS (SELECT tree, i // 16 AS r, string_agg(h, '' ORDER BY i) AS hs, any_value(n) AS n FROM {a}{k} WHERE n > 1 GROUP BY ALL)")
            parts.append(f"{a}{k + 1} AS (SELECT tree, r AS i, sha256(hs) AS h, (n + 15) // 16 AS n FROM r{a}{k})")
            parts.append(
                f"{p}{k + 1} AS (SELECT doc_id, leaf, {more} CASE WHEN hs IS NULL THEN cur ELSE sha256(hs[1:64 * (i % 16)] || cur || hs[64 * (i % 16) + 65:]) END AS cur,"
                f" CASE WHEN hs IS NULL THEN proof ELSE proof || hs[1:64 * (i % 16)] || hs[64 * (i % 16) + 65:] END AS proof, gi, (p.n + 15) // 16 AS n, p.tree, i // 16 AS i"
                f" FROM {p}{k} p LEFT JOIN r{a}{k} q ON q.tree = p.tree AND q.r = p.i // 16)"
            )

    climb("a", "p", levels, "")
    roots = " UNION ALL ".join(f"SELECT tree, h FROM a{k} WHERE n = 1" for k in range(levels + 1))
    # A tree of one node stays as it is in all levels above, so the first of its levels with one node counts.
    parts.append(f"s AS (SELECT tree AS gi, h AS subroot FROM ({roots}))")
    parts.append("b0 AS (SELECT 0 AS tree, gi AS i, subroot AS h, (SELECT count(*) FROM g) AS n FROM s)")
    parts.append(f"t0 AS (SELECT doc_id, leaf, subroot, cur, proof, gi, (SELECT count(*) FROM g) AS n, 0 AS tree, gi AS i FROM p{levels} JOIN s USING (gi))")
    climb("b", "t", top_levels, "subroot,")
    top = " UNION ALL ".join(f"SELECT h FROM b{k} WHERE n = 1" for k in range(top_levels + 1))
    return f"WITH {', '.join(parts)}, top AS (SELECT h AS root FROM ({top})) SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, cur AS folded_root, cur = root AS verified FROM t{top_levels}, top"

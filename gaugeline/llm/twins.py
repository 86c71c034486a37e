"""SQL (DuckDB) for the same rows as queries of this package, where SQL can express them."""

from __future__ import annotations

from gaugeline.llm.shards import BITS, hilbert_tables

POLYNOMIAL = 0xEDB88320  # fixed value of CRC-32
LONGEST = 18  # checksums of texts of fewer than 2 ** LONGEST bytes


def _times_x(v: int, k: int) -> int:
    for _ in range(k):
        v = (v >> 1) ^ (POLYNOMIAL if v & 1 else 0)
    return v


def _product(a: int, b: int) -> int:
    out = 0
    for j in range(32):
        if a >> (31 - j) & 1:
            out ^= _times_x(b, j)
    return out


def _xor(terms: list[str]) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"xor({out}, {t})"
    return out


def _product_sql(v: str, b: int) -> str:
    return _xor([f"(CASE WHEN ({v} >> {31 - j}) & 1 = 1 THEN {_times_x(b, j)}::BIGINT ELSE 0::BIGINT END)" for j in range(32)])


def crc32_tables(texts: str) -> str:
    """Tables that end in ``crc (text, crc)``, for a table ``texts`` of distinct non-null texts in its column ``text``.

    A checksum is a sum without carry: a byte ``k`` places before the end gives the byte times ``x ** (8 * k)`` modulo the polynomial, and
    so does the start value of all ones before the text. The powers come from doubling.
    """
    parts, step = [f"pow0 AS (SELECT 0::BIGINT AS k, {1 << 31}::BIGINT AS v)"], _times_x(1 << 31, 8)
    for i in range(LONGEST):
        parts.append(f"pow{i + 1} AS MATERIALIZED (SELECT k, v FROM pow{i} UNION ALL SELECT k + {1 << i}, {_product_sql('v', step)} FROM pow{i})")
        step = _product(step, step)
    # p0 is what the highest bit of the byte gives, p7 what the lowest does.
    parts.append(f"bit0 AS (SELECT k, {_product_sql('v', 0xFFFFFFFF)} AS start, {_product_sql('v', 1 << 7)} AS p0 FROM pow{LONGEST})")
    for i in range(7):
        parts.append(f"bit{i + 1} AS (SELECT *, xor(p{i} >> 1, CASE WHEN p{i} & 1 = 1 THEN {POLYNOMIAL}::BIGINT ELSE 0::BIGINT END) AS p{i + 1} FROM bit{i})")
    parts.append("powers AS MATERIALIZED (SELECT * FROM bit7)")
    parts.append(f"hexed AS MATERIALIZED (SELECT text, row_number() OVER () AS t, strlen(text) AS n, regexp_extract_all(hex(encode(text)), '..') AS h FROM {texts})")
    parts.append("bytes AS (SELECT t, n - unnest(range(0, n)) AS k, ('0x' || unnest(h))::INT AS b FROM hexed WHERE n > 0)")
    given = _xor([f"(CASE WHEN (b >> {7 - i}) & 1 = 1 THEN p{i} ELSE 0::BIGINT END)" for i in range(8)])
    parts.append(f"given AS (SELECT t, bit_xor({given}) AS c FROM bytes JOIN powers USING (k) GROUP BY t)")
    parts.append(f"crc AS (SELECT text, xor(xor(coalesce(c, 0), start), {0xFFFFFFFF}::BIGINT) AS crc FROM hexed LEFT JOIN given USING (t) JOIN powers ON powers.k = n)")
    return ", ".join(parts)


def hilbert_shards(dims: list[str], shards: int = 16) -> str:
    """Equal counts along the curve through columns of ``documents``."""
    n, cells = len(dims), 1 << BITS
    digit, follow = hilbert_tables(n)
    parts = ["docs AS (SELECT row_number() OVER () AS r, * REPLACE (coalesce(text, '') AS text) FROM documents)", "texts AS (SELECT DISTINCT text FROM docs)", crc32_tables("texts")]
    joins = []
    for i, d in enumerate(dims):
        parts.append(f"dim{i} AS (SELECT r, ((rank() OVER (ORDER BY {d}) - 1) * {cells}) // count(*) OVER () AS c{i} FROM docs WHERE {d} IS NOT NULL)")
        joins.append(f"LEFT JOIN dim{i} USING (r)")
    parts.append(f"level{BITS} AS (SELECT doc_id, (strlen(text) + 1)::BIGINT AS size, crc AS text_crc32, {', '.join(f'coalesce(c{i}, 0) AS c{i}' for i in range(n))}, 0::BIGINT AS curve, 0 AS state FROM docs JOIN crc USING (text) {' '.join(joins)})")
    for level in reversed(range(BITS)):
        k = f"(state * {1 << n} + {' + '.join(f'((c{i} >> {level}) & 1) * {1 << i}' for i in range(n))} + 1)"
        parts.append(f"level{level} AS (SELECT * REPLACE (curve * {1 << n} + {digit}[{k}] AS curve, {follow}[{k}] AS state) FROM level{level + 1})")
    parts.append("ranked AS (SELECT *, row_number() OVER (ORDER BY curve, size, text_crc32, doc_id NULLS FIRST) - 1 AS rank, count(*) OVER () AS n FROM level0)")
    return f"""WITH {', '.join(parts)}
SELECT doc_id, size, text_crc32, 'rows' AS law, ((rank * {shards}) // n)::INT AS shard, rank - (((rank * {shards}) // n) * n + {shards - 1}) // {shards} AS slot, NULL::INT AS grown_shard, curve FROM ranked"""


FILL_IN_MIDDLE = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, CASE WHEN text = '' THEN []::VARCHAR[] ELSE regexp_extract_all(text, '[^\n]*\n|[^\n]+') END AS units,
  ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2, ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(units)::BIGINT AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1))::BIGINT AS b FROM u),
p AS (SELECT *, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd's rounds over ``embeddings``, one after another; lengths that ``parts`` divides."""
    t = [
        "good AS (SELECT vec_id, label, embedding AS v, row_number() OVER (ORDER BY vec_id, embedding) AS r FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"part AS MATERIALIZED (SELECT r, p, list_transform(v[(p * len(v)) // {parts} + 1:((p + 1) * len(v)) // {parts}], lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS q FROM good, range(0, {parts}) AS t(p))",
        f"book0 AS MATERIALIZED (SELECT p, r - 1 AS e, q AS c FROM part WHERE r <= {entries})",
    ]
    far = "list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - c[i]) * (q[i] - c[i])))::BIGINT"
    for i in range(rounds + 1):
        t.append(f"near{i} AS MATERIALIZED (SELECT r, p, any_value(q) AS q, min({{'d': {far}, 'e': e}}) AS best FROM part JOIN book{i} USING (p) GROUP BY r, p)")
        if i < rounds:
            t.append(f"sum{i} AS (SELECT p, best.e AS e, i, sum(q[i])::BIGINT AS a, count(*) AS n FROM near{i}, range(1, len(q) + 1) AS t(i) GROUP BY p, best.e, i)")
            # Whole-number division rounds towards zero, so floors of negative sums take one off unless they divide.
            t.append(f"mean{i} AS (SELECT p, e, list(CASE WHEN a >= 0 OR a % n = 0 THEN a // n ELSE -((-a) // n) - 1 END ORDER BY i) AS c FROM sum{i} GROUP BY p, e)")
            t.append(f"book{i + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{i} b LEFT JOIN mean{i} m ON m.p = b.p AND m.e = b.e)")
    t.append(f"coded AS (SELECT r, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, sum(best.d)::BIGINT AS error FROM near{rounds} GROUP BY r)")
    t.append(f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})")
    return f"""WITH {', '.join(t)}
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM good JOIN coded USING (r), digest"""

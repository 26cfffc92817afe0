"""Expected results in SQL of the corpus queries that SQL can express."""

_LINES = """
WITH lines AS (
    SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line,
           generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents WHERE text IS NOT NULL
), spread AS (
    SELECT trim(line, ' ') AS line FROM lines WHERE trim(line, ' ') <> '' AND source IS NOT NULL
    GROUP BY 1 HAVING count(DISTINCT source) >= 10 AND count(DISTINCT text) >= 10
), cut AS (
    SELECT doc_id, count(*) FILTER (WHERE s.line IS NOT NULL) AS n_removed,
           coalesce(string_agg(l.line, chr(10) ORDER BY pos) FILTER (WHERE s.line IS NULL), '') AS kept
    FROM lines l LEFT JOIN spread s ON trim(l.line, ' ') = s.line GROUP BY doc_id
), cleaned AS (
    SELECT d.doc_id, len(string_split(d.text, chr(10))) AS n_lines, n_removed, CASE WHEN n_removed > 0 THEN kept ELSE d.text END AS text
    FROM documents d LEFT JOIN cut USING (doc_id)
)
SELECT doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       length(text)::BIGINT AS n_left, md5(text) AS text_md5
FROM cleaned
"""

_RECORDS = """
WITH payloads AS (
    SELECT page_id, url, coalesce(html, '') AS html, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages
), sized AS (
    SELECT *, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest, chr(13) || chr(10) AS eol,
           octet_length(encode(html)) >= 100 AND page_id <> owner AS revisits
    FROM payloads
), records AS (
    SELECT *, 'WARC/1.1' || eol || 'WARC-Type: ' || CASE WHEN revisits THEN 'revisit' ELSE 'response' END || eol
           || 'WARC-Record-ID: <urn:page:' || page_id || '>' || eol || 'WARC-Date: 2024-01-01T00:00:00Z' || eol
           || coalesce('WARC-Target-URI: ' || url || eol, '') || 'WARC-Payload-Digest: sha256:' || payload_digest || eol
           || CASE WHEN revisits THEN 'WARC-Refers-To: <urn:page:' || owner || '>' || eol
              || 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest' || eol ELSE '' END
           || 'Content-Type: text/html; charset=utf-8' || eol || 'Content-Length: ' || payload_bytes || eol || eol
           || html || eol || eol AS record
    FROM sized
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisits THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisits THEN owner END AS refers_to, octet_length(encode(record))::BIGINT AS record_bytes,
       sha256(record) AS record_digest
FROM records
"""

# Unsigned crc32 of a text, over the table of its polynomial (fixed value).
_CRC = """
crc_table AS (
    SELECT list(value ORDER BY byte) AS crcs FROM (
        SELECT byte, list_reduce(list_prepend(byte, range(8)), lambda c, _: xor(c >> 1, (c & 1) * 3988292384)) AS value
        FROM (SELECT unnest(range(256)) AS byte)
    )
)"""


def _crc(text: str) -> str:
    octets = f"list_transform(regexp_extract_all(hex({text}), '..'), lambda x: ('0x' || x)::BIGINT)"
    step = "xor(c >> 8, crcs[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {step}), 4294967295)"


def _framed(value: str) -> str:
    return f"coalesce(octet_length(encode({value}::VARCHAR)) || ':' || {value}::VARCHAR, '-')"


def _tree(name: str, height: int) -> str:
    """Nodes of all levels over ``{name}_0``; a tree that is down to one node keeps it."""
    levels = []
    for i in range(1, height + 1):
        levels.append(f"""
{name}_{i} AS (
    SELECT tree, pos // 8 AS pos, (any_value(n) + 7) // 8 AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h, string_agg(h, '' ORDER BY pos) AS run
    FROM {name}_{i - 1} WHERE n > 1 GROUP BY tree, pos // 8
    UNION ALL SELECT tree, pos, n, h, NULL FROM {name}_{i - 1} WHERE n = 1
)""")
    return ",".join(levels)


def _fold(name: str, height: int, before: str) -> str:
    """Table after table: the hash carried one level up, and the siblings met."""
    steps = []
    for i in range(1, height + 1):
        slot = f"64 * ((u.pos // {8 ** (i - 1)}) % 8)"
        left, right = f"left(t.run, {slot})", f"substr(t.run, {slot} + 65)"
        steps.append(f"""
{name}_up_{i} AS (
    SELECT u.* REPLACE (CASE WHEN t.run IS NULL THEN u.h ELSE sha256({left} || u.h || {right}) END AS h,
                        u.siblings || coalesce({left} || {right}, '') AS siblings)
    FROM {before if i == 1 else f"{name}_up_{i - 1}"} u JOIN {name}_{i} t ON t.tree = u.tree AND t.pos = u.pos // {8**i}
)""")
    return ",".join(steps)


_MANIFEST = f"""
WITH {_CRC.strip()}, leaves AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, sha256(own || {_framed("text")}) AS leaf,
           CASE WHEN lowered THEN sha256(own || {_framed("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")})
           ELSE sha256(own || {_framed("text")}) END AS found
    FROM (
        SELECT *, {_framed("doc_id")} || {_framed("source")} || {_framed("lang")} || {_framed("n_chars")} AS own,
               coalesce({_crc("doc_id::VARCHAR")} % 3 = 0, false) AS lowered
        FROM documents, crc_table
    )
), tree_0 AS (
    SELECT *, leaf AS h, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n
    FROM leaves
), {_tree("tree", 7)}, top_0 AS (
    SELECT '' AS tree, tree AS name, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM tree_7
), {_tree("top", 3)}, started AS (
    SELECT doc_id, leaf, tree, pos, found AS h, '' AS siblings FROM tree_0
), {_fold("tree", 7, "started")}, above AS (
    SELECT u.doc_id, u.leaf, u.h, u.siblings, t.tree, t.pos, t.h AS subroot FROM tree_up_7 u JOIN top_0 t ON t.name = u.tree
), {_fold("top", 3, "above")}
SELECT doc_id, leaf, subroot, (SELECT h FROM top_3) AS root, sha256(siblings) AS proof_sha256, h AS folded_root,
       h = (SELECT h FROM top_3) AS verified
FROM top_up_3
"""

_SHARDS = f"""
WITH RECURSIVE {_CRC.strip()}, sized AS (
    SELECT doc_id, octet_length(encode(body)) + 16 AS size, {_crc("body")} AS text_crc32, ('0x' || substr(md5(body), 1, 15))::BIGINT AS place
    FROM (SELECT doc_id, coalesce(text, '') AS body FROM documents), crc_table
), groups AS (
    SELECT place, sum(size)::BIGINT AS bytes, row_number() OVER (ORDER BY sum(size) DESC, place) AS number FROM sized GROUP BY place
), alone AS (
    SELECT place, number - 1 AS shard FROM (
        SELECT *, bool_and(number < 40 AND bytes * (41 - number) >= left_over) OVER (ORDER BY number) AS single FROM (
            SELECT *, sum(bytes) OVER () - sum(bytes) OVER (ORDER BY number) + bytes AS left_over FROM groups
        )
    ) WHERE single
), rest AS (
    SELECT place, sum(bytes) OVER (ORDER BY place)::BIGINT AS last, (sum(bytes) OVER (ORDER BY place) - bytes)::BIGINT AS first
    FROM groups WHERE place NOT IN (SELECT place FROM alone)
), known AS (
    SELECT list_prepend(0::BIGINT, list(last ORDER BY last)) AS ends, max(last) AS total, 40 - (SELECT count(*) FROM alone) AS k FROM rest
), search AS (
    SELECT ((total + k - 1) // k)::BIGINT AS low, total::BIGINT AS high FROM known
    UNION ALL
    SELECT CASE WHEN fits THEN low ELSE middle + 1 END, CASE WHEN fits THEN middle ELSE high END FROM (
        SELECT low, high, middle, total <= list_reduce(
            list_prepend(0::BIGINT, range(k)), lambda spot, _: list_max(list_filter(ends, lambda p: p <= spot + middle))) AS fits
        FROM (SELECT *, (low + high) // 2 AS middle FROM search), known WHERE low < high
    )
), capacity AS (
    SELECT low AS capacity FROM search WHERE low = high
), back AS (
    SELECT k AS j, total AS earliest FROM known
    UNION ALL
    SELECT j - 1, list_min(list_filter(ends, lambda p: p >= earliest - capacity)) FROM back, known, capacity WHERE j > 1
), nearest AS (
    SELECT j, CASE WHEN even - before <= after - even THEN before ELSE after END AS best FROM (
        SELECT j, even, list_max(list_filter(ends, lambda p: p <= even)) AS before, list_min(list_filter(ends, lambda p: p >= even)) AS after
        FROM (SELECT j, total * j // k AS even, ends FROM back, known WHERE j < k)
    )
), cuts AS (
    SELECT 0::BIGINT AS j, 0::BIGINT AS spot
    UNION ALL
    SELECT n.j, greatest(CASE WHEN best > spot + capacity THEN list_max(list_filter(ends, lambda p: p <= spot + capacity)) ELSE best END, earliest, spot)
    FROM cuts c JOIN nearest n ON n.j = c.j + 1 JOIN back b ON b.j = n.j, known, capacity
), shards AS (
    SELECT place, shard FROM alone
    UNION ALL
    SELECT place, (SELECT count(*) FROM alone) + len(list_filter((SELECT list(spot) FROM cuts WHERE j > 0), lambda c: c <= first)) FROM rest
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'bytes' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY place, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM sized JOIN shards USING (place)
"""

ORACLE: dict[str, str] = {
    "op9_line_spread": _LINES,
    "op10_warc": _RECORDS,
    "op11_merkle_manifest": _MANIFEST,
    "op13_sharding": _SHARDS,
}

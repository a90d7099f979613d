"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, fingerprints, langid, packing, pii, secrets, simhash, substring_dedup, warc
from .common import table

#: The vocabulary that packing uses unless another path is given.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    sample = spark.sql(f"SELECT * FROM VALUES (-1L, 0L, 'user', '{said}'), (-1L, 1L, 'assistant', '{said}') AS t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.windows(turns.unionByName(sample)))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages")).drop("url")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(table(spark, sf_dir, "documents")))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.scan(table(spark, sf_dir, "documents")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    held = F.coalesce(langid.held_out(F.col("doc_id")), F.lit(False))
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_warc, op3_secrets, op4_pii, op5_simhash, op6_decontaminate, op7_langid, op8_substring_dedup, op9_packing, op10_fingerprints, pipeline)
}

#: Control strings whole, as SQL counts them.
CONTROL = r"<\||</?s>|<</?SYS>>|<unk>|<pad>|\[/?INST\]|\[/?TOOL_CALLS\]|\[/?AVAILABLE_TOOLS\]"


def chat_sql(budget: int = chat_format.BUDGET, most: int = chat_format.HISTORY_TURNS, tokens: int = chat_format.HISTORY_TOKENS) -> str:
    """The windows cut turn by turn, and the characters they take."""
    count = lambda x, p: f"len(regexp_extract_all({x}, '{p}'))"
    escaped = lambda x: f"(length({x}) + length({x}) - length(replace({x}, chr(92), '')) + {count(x, CONTROL)})"
    marks = len(chat_format.START) + len(chat_format.SEP) + len(chat_format.END)
    w = "(PARTITION BY conv_id ORDER BY i)"
    lags = [f"(upto - cost - lag(upto, {h + 1}, 0) OVER {w})" for h in range(1, most + 1)]
    fits = [f"i > {h} AND NOT lag(sys, {h}) OVER {w} AND {x} <= {tokens}" for h, x in enumerate(lags, 1)]
    back = "CASE " + " ".join(f"WHEN {f} THEN {h}" for h, f in reversed([*enumerate(fits, 1)])) + " ELSE 0 END"
    hist = "CASE " + " ".join(f"WHEN {f} THEN {x}" for f, x in reversed([*zip(fits, lags)])) + " ELSE 0 END"
    return rf"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                     UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
              {count('text', chat_format.TOKEN)} + {count('role', chat_format.TOKEN)} + {chat_format.OVERHEAD} AS n, {escaped('role')} + {escaped('text')} + {marks} AS chars FROM c),
t1 AS (SELECT *, i = 1 AND role = 'system' AS sys, CASE WHEN i = 1 AND role = 'system' THEN 0 ELSE n END AS cost FROM t0),
t2 AS (SELECT *, sum(cost) OVER {w} AS upto, max(CASE WHEN sys THEN n ELSE 0 END) OVER (PARTITION BY conv_id) AS sysn, max(CASE WHEN sys THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS syschars FROM t1),
t AS (SELECT *, {back} AS back, {hist} AS hist FROM t2),
r AS (SELECT conv_id, i, 0::HUGEINT AS before, 0::HUGEINT AS h, i AS first FROM t WHERE i = 1
      UNION ALL
      SELECT t.conv_id, t.i, CASE WHEN o THEN t.upto - t.n ELSE r.before END, CASE WHEN o THEN t.hist ELSE r.h END, CASE WHEN o THEN t.i ELSE r.first END
      FROM (SELECT r.*, t.i AS ni, NOT t.sys AND t.upto - r.before + r.h + t.sysn > {budget} AND t.i > r.first AND t.upto - t.n > r.before AS o FROM r JOIN t ON t.conv_id = r.conv_id AND t.i = r.i + 1) r
      JOIN t ON t.conv_id = r.conv_id AND t.i = r.ni),
win AS (SELECT conv_id, first, max(i) AS last FROM r GROUP BY 1, 2),
own AS (SELECT win.conv_id, first, last, b.sysn, b.syschars, CASE WHEN first > 1 AND e.upto - (b.upto - b.cost) + b.hist + b.sysn <= {budget} THEN b.back ELSE 0 END AS back
        FROM win JOIN t b ON b.conv_id IS NOT DISTINCT FROM win.conv_id AND b.i = first JOIN t e ON e.conv_id IS NOT DISTINCT FROM win.conv_id AND e.i = last),
size AS (SELECT own.conv_id, sum(chars) AS chars FROM own JOIN t ON t.conv_id IS NOT DISTINCT FROM own.conv_id AND t.i BETWEEN first - own.back AND last GROUP BY 1),
again AS (SELECT conv_id, sum(CASE WHEN first > 1 THEN syschars ELSE 0 END) AS chars FROM own GROUP BY 1),
told AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256, coalesce(string_agg(text, '' ORDER BY i) FILTER (WHERE role = 'assistant'), '') AS l FROM t GROUP BY 1)
SELECT told.conv_id, n_turns, turns_sha256, length(l)::BIGINT AS loss_chars, sha256(l) AS loss_sha256, (size.chars + again.chars)::BIGINT AS formatted_chars
FROM told JOIN size ON size.conv_id IS NOT DISTINCT FROM told.conv_id JOIN again ON again.conv_id IS NOT DISTINCT FROM told.conv_id
"""


def secrets_sql() -> str:
    """Spans by the lengths of matches and of what stands between them; entropies window by window."""
    d = "(SELECT doc_id, coalesce(text, '') AS t FROM documents)"
    assign = secrets.ASSIGN.replace("'", "''")

    def places(pattern: str, rank: int, name: str, part: int = 0, ok: str = "true") -> str:
        return rf"""SELECT doc_id, pos AS start, {rank} AS rank, pos + length(m) AS stop, m, '{name}' AS kind FROM (
  SELECT doc_id, m, p, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM (SELECT doc_id, unnest(found) AS m, unnest(parts) AS p, unnest(gaps[1:len(found)]) AS g, unnest(range(len(found))) AS k
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, regexp_extract_all(t, '{pattern}', {part}) AS parts, string_split_regex(t, '{pattern}') AS gaps FROM {d}))) WHERE {ok}"""

    def hot(k: int, c: secrets.CharClass) -> str:
        allowed = " OR ".join(f"regexp_matches(m, '{p}')" for p in secrets.ALLOW)
        return rf"""SELECT doc_id, start + min(i) AS start, {3 + k} AS rank, start + max(i) + {c.window} AS stop, m, 'entropy_{c.name}' AS kind FROM (
  SELECT doc_id, start, m, i, sum(n * log2(n)) AS s FROM (
    SELECT doc_id, start, m, i, ch, count(*) AS n FROM (SELECT doc_id, start, m, i, unnest(string_split(substr(m, i + 1, {c.window}), '')) AS ch FROM (SELECT *, unnest(range(length(m) - {c.window} + 1)) AS i FROM cand{k} WHERE NOT ({allowed}))) GROUP BY ALL)
  GROUP BY ALL) WHERE s <= {c.window * (math.log2(c.window) - c.bits) + 1e-9!r} GROUP BY doc_id, start, m"""

    hexes, b64 = secrets.CLASSES
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) {}, '')"
    return rf"""
WITH cand0 AS ({places('[A-Za-z0-9]+', 3, 'c', 0, f"regexp_full_match(m, '[0-9a-fA-F]{{{hexes.window},}}')")}),
cand1 AS ({places(f'[A-Za-z0-9+/_=-]{{{b64.window},}}', 4, 'c')}),
s AS ({places(assign, 0, 'assign', 2, f'length(p) >= {secrets.ASSIGN_VALUE}')}
  UNION ALL {places(secrets.ACCESS, 1, 'access')} UNION ALL {places(secrets.HEX, 2, 'hex')} UNION ALL {hot(0, hexes)} UNION ALL {hot(1, b64)})
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
       sha256({listed.format('FILTER (WHERE rank < 3)')}) AS base_sha256, {listed.format('FILTER (WHERE rank IS NOT NULL)')} AS spans, count(*) FILTER (WHERE rank >= 3) AS n_entropy
FROM documents d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


def fingerprints_sql(k: int = fingerprints.K, w: int = fingerprints.WINDOW, prime: int = fingerprints.PRIME) -> str:
    """Winnowing by lists: hashes of runs of k words, the least of each w of them, the rightmost of ties; all where they are fewer."""
    power = lambda n: [pow(1_000_003, n - 1 - j, prime) for j in range(n)]
    term = lambda i, n: "(" + " + ".join(f"(h[{i} + {j}] * {c} % {prime})" for j, c in enumerate(power(n))) + f") % {prime}"
    few = " ".join(f"WHEN len(h) = {n} THEN [{term('1', n)}]" for n in range(1, k))
    unit = fingerprints.UNIT
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lead(coalesce(text, '')) OVER o AS nx, first_value(coalesce(text, '')) OVER o AS top FROM documents
           WINDOW o AS (ORDER BY doc_id DESC NULLS LAST, md5(coalesce(text, '')) DESC)),
e AS (SELECT row_number() OVER () AS id, doc_id, t, coalesce(nx, top) AS nx, length(t) // 2 AS half FROM d),
x AS (SELECT id, doc_id, t, nx, substr(t, 1, length(t) - half) || substr(nx, 1, half) AS ed FROM e),
k0 AS (SELECT id, 'own' AS kind, t AS s FROM x UNION ALL SELECT id, 'ed', ed FROM x UNION ALL SELECT id, 'nx', nx FROM x),
k1 AS (SELECT id, kind, list_transform(regexp_extract_all(s, '{unit}'), lambda v: ('0x' || substr(md5(v), 1, 7))::BIGINT) AS h FROM k0),
k2 AS (SELECT id, kind, CASE WHEN len(h) = 0 THEN []::BIGINT[] {few} ELSE list_transform(range(1, len(h) - {k - 2}), lambda i: {term('i', k)}) END AS g FROM k1),
k3 AS (SELECT id, kind, list_transform(g, lambda v, i: v * 2147483648 + 2147483647 - (i - 1)) AS p FROM k2),
k4 AS (SELECT id, kind, CASE WHEN len(p) < {w} THEN p ELSE list_transform(range(1, len(p) - {w - 2}), lambda i: list_min(p[i:i + {w - 1}])) END AS m FROM k3),
k5 AS (SELECT id, kind, list_filter(m, lambda v, i: i = 1 OR v <> m[i - 1]) AS m FROM k4),
k6 AS (SELECT id, kind, CASE WHEN len(m) = 0 THEN '' ELSE list_aggregate(list_transform(m, lambda v: lower(to_hex(v // 2147483648)) || '@' || (2147483647 - v % 2147483648)), 'string_agg', ' ') END AS f,
              list_distinct(list_transform(m, lambda v: v // 2147483648)) AS hs FROM k5),
l AS (SELECT x.doc_id, length(t)::BIGINT AS n_chars, sha256(ed) AS edited_sha256, a.f AS fingerprint, b.f AS edited_fingerprint, a.hs AS ha, b.hs AS hb, c.hs AS hc
      FROM x JOIN k6 a ON a.id = x.id AND a.kind = 'own' JOIN k6 b ON b.id = x.id AND b.kind = 'ed' JOIN k6 c ON c.id = x.id AND c.kind = 'nx')
SELECT doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
       CASE WHEN len(ha) + len(hb) = 0 THEN 1.0 ELSE len(list_intersect(ha, hb))::DOUBLE / (len(ha) + len(hb) - len(list_intersect(ha, hb))) END AS near_edited,
       CASE WHEN len(ha) + len(hc) = 0 THEN 1.0 ELSE len(list_intersect(ha, hc))::DOUBLE / (len(ha) + len(hc) - len(list_intersect(ha, hc))) END AS near_next
FROM l
"""


ORACLES: dict[str, str] = {
    "op1_chat_format": chat_sql(),
    "op3_secrets": secrets_sql(),
    "op10_fingerprints": fingerprints_sql(),
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
     d AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS s FROM p),
     f AS (SELECT s, min(page_id) AS first_id FROM d WHERE n >= 100 GROUP BY s)
SELECT page_id, n::BIGINT AS payload_bytes, d.s AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM d LEFT JOIN f ON f.s = d.s AND n >= 100
""",
    "op8_substring_dedup": r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents),
     win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w),
     k AS (SELECT doc_id, i, sha256(list_aggregate(ws[i:i + 12], 'string_agg', ' ')) AS s FROM win),
     lo AS (SELECT s, min(doc_id) AS first_id FROM k GROUP BY s),
     gone AS (SELECT DISTINCT k.doc_id, unnest(range(i, i + 13)) AS i FROM k JOIN lo USING (s) WHERE k.doc_id > first_id),
     per AS (SELECT doc_id, list(i) AS cut FROM gone GROUP BY doc_id),
     kept AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(len(cut), 0) AS n_removed,
                     list_filter(ws, lambda x, j: NOT list_contains(coalesce(cut, []::BIGINT[]), j)) AS kw
              FROM w LEFT JOIN per USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, n_removed::BIGINT AS n_removed,
       sha256(CASE WHEN len(kw) = 0 THEN '' ELSE list_aggregate(kw, 'string_agg', ' ') END) AS kept_sha256
FROM kept
""",
}

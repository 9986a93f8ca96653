"""Registered queries of the operators on documents, with their oracle SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import chat, collocations, cuckoo, cws, langid, lines, lm, merkle, mixing, packing, simhash, spieces, toxicity
from riskloom.llm.common import documents, lower_ascii
from riskloom.session import checkpoint

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, source_size * 3.0::DOUBLE AS most FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w
), t AS (
  SELECT source, source_size,
    CASE WHEN level * w < most THEN w * first_value(CASE WHEN level * w < most THEN level END IGNORE NULLS) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) ELSE most END AS target,
    ('0x' || substr(md5('mix:' || coalesce(source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM l
), o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY d.source ORDER BY length(d.size::VARCHAR) * 10 + substr(d.size::VARCHAR, 1, 1)::INT, ((d.doc_id % 256) + 256) % 256, d.size, d.doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), c AS (
  SELECT *, (floor(i * rate + u) - floor((i - 1) * rate + u))::BIGINT AS copies FROM o
)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""


@query()
def op1_sentencepiece(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    pieces = spieces.Pieces()
    coded = spieces.encode(documents(spark, d, "doc_id", "text"), pieces)
    return coded.withColumn("decodes", F.col("decoded_sha256") == F.col("text_sha256")).drop("decoded_sha256")


@query()
def op2_lm_score(spark: SparkSession, d: str) -> DataFrame:
    """Unigram and mixed-context scores of every document."""
    return lm.score(documents(spark, d, "doc_id", "text"))


@query()
def op3_language(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document."""
    return langid.identify(documents(spark, d, "doc_id", "text", "lang"))


@query(MIX_SQL)
def op4_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    """Words, target of the source and words taken of every document."""
    sized = checkpoint(documents(spark, d, "doc_id", "source", "text").select("doc_id", "source", mixing.size_of("text").alias("size")))
    return mixing.mix(sized).select("doc_id", "size", "source_size", "target", "copies", "taken")


TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}}, "required": ["query"], "additionalProperties": False},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}
"""Schemas of the tools that conversations may call."""


@query("""
SELECT conv_id, turn, 0::INT AS place, coalesce(role, '') AS role, 0::BIGINT AS n_calls, 0::BIGINT AS n_linked,
  '{"content":' || to_json(coalesce(text, '')) || ',"role":' || to_json(coalesce(role, '')) || '}' AS message
FROM conversations WHERE coalesce(role, '') <> 'tool' AND NOT contains(coalesce(text, ''), '<tool_call>')
""")
def op5_chat_format(spark: SparkSession, d: str) -> DataFrame:
    """Every message as canonical JSON, calls linked to results."""
    return chat.format_chats(spark.read.parquet(f"{d}/conversations.parquet"), TOOLS)


@query()
def op6_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Toxicity of every document."""
    return toxicity.toxicity(documents(spark, d, "doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet"))


@query("""
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size,
  (d.doc_id IS NOT DISTINCT FROM g.keep_id) AND row_number() OVER (PARTITION BY d.doc_id, d.h) = 1 AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
""")
def op7_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Groups of equal texts, found by the cuckoo-filter index."""
    return cuckoo.exact_dedup(documents(spark, d, "doc_id", "text"))


@query()
def op8_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprints of every document and its edited text."""
    return cws.fingerprint(documents(spark, d, "doc_id", "text"))


@query()
def op9_simhash_near_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_dedup(documents(spark, d, "doc_id", "text")).drop("version")


LINES_SQL = f"""
WITH d AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM d),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND k.doc_id <> r.last AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


@query(LINES_SQL)
def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Lines dropped from every document and the hash of what stays."""
    docs = documents(spark, d, "doc_id", "text")
    kept = lines.apply_bitmaps(docs, lines.line_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256).alias("kept_sha256"))


@query()
def op13_pack_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(documents(spark, d, "doc_id", "text"))


CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda c: ascii(c)::BIGINT)),
  lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)"""


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(strlen({c})::VARCHAR || ':' || {c}, '-')" for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)]
    return f"sha256({' || '.join(fields)})"


MERKLE_SQL = f"""
WITH RECURSIVE l AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql('text')} AS leaf, CASE WHEN ({CRC_SQL}) % 3 = 0 THEN {_leaf_sql(LOWER.format('text'))} END AS shown FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l),
n AS (
  SELECT tree, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY tree) AS c FROM p
  UNION ALL
  SELECT tree, level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(c) + 7) // 8 FROM n WHERE c > 1 GROUP BY tree, level, pos // 8
), g AS (SELECT tree, arg_max(h, level) AS h, max(level) AS levels, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos, count(*) OVER () AS c FROM n GROUP BY tree),
u AS (
  SELECT 0 AS level, pos, h, c FROM g
  UNION ALL
  SELECT level + 1, pos // 8, sha256(string_agg(h, '' ORDER BY pos)), (any_value(c) + 7) // 8 FROM u WHERE c > 1 GROUP BY level, pos // 8
), s AS (
  SELECT p.doc_id, p.leaf, p.shown, g.h AS subroot, (SELECT arg_max(h, level) FROM u) AS root, p.tree, p.pos, g.levels, g.pos AS place, (SELECT max(level) FROM u) AS tops FROM p JOIN g USING (tree)
), w AS (
  SELECT s.tree, s.pos, x.level AS n, x.pos AS sib, x.h, s.pos // (8 ** x.level)::BIGINT AS me FROM s JOIN n x ON x.tree = s.tree AND x.level < s.levels AND x.pos // 8 = s.pos // (8 ** (x.level + 1))::BIGINT
  UNION ALL
  SELECT s.tree, s.pos, s.levels + x.level, x.pos, x.h, s.place // (8 ** x.level)::BIGINT FROM s JOIN u x ON x.level < s.tops AND x.pos // 8 = s.place // (8 ** (x.level + 1))::BIGINT
), q AS (
  SELECT tree, pos, sha256(coalesce(string_agg(h, '' ORDER BY n, sib) FILTER (sib <> me), '')) AS proof FROM w GROUP BY tree, pos
), a AS (
  SELECT tree, pos, n, coalesce(string_agg(h, '' ORDER BY sib) FILTER (sib < me), '') AS lo, coalesce(string_agg(h, '' ORDER BY sib) FILTER (sib > me), '') AS hi FROM w GROUP BY tree, pos, n
), f AS (
  SELECT tree, pos, 0 AS n, coalesce(shown, leaf) AS x FROM s
  UNION ALL
  SELECT f.tree, f.pos, f.n + 1, sha256(a.lo || f.x || a.hi) FROM f JOIN a ON a.tree = f.tree AND a.pos = f.pos AND a.n = f.n
), e AS (SELECT tree, pos, arg_max(x, n) AS folded FROM f GROUP BY tree, pos)
SELECT s.doc_id, s.leaf, s.subroot, s.root, coalesce(q.proof, sha256('')) AS proof_sha256, e.folded AS folded_root, e.folded = s.root AS verified
FROM s JOIN e USING (tree, pos) LEFT JOIN q USING (tree, pos)
"""


@query(MERKLE_SQL)
def op11_merkle_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; a third are shown with altered text."""
    docs = documents(spark, d)
    altered = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 0
    return merkle.manifest(docs, altered, lower_ascii(F.col("text"))).drop("siblings", "place")


_grams = " UNION ALL ".join(f"SELECT lang, concat_ws(' ', {', '.join(f'w{i}' for i in range(1, m + 1))}) AS p, {m} AS m FROM g WHERE w{m} IS NOT NULL" for m in range(1, 5))
PHRASES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, {LOWER.format("coalesce(text, '')")} AS t FROM documents),
x AS (SELECT doc, lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) AS k FROM d),
y AS (SELECT doc, lang, k, unnest(regexp_extract_all(piece, '[^\x20\x09]+')) AS w, generate_subscripts(regexp_extract_all(piece, '[^\x20\x09]+'), 1) AS i FROM x),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM y WINDOW o AS (PARTITION BY doc, k ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f AS (SELECT lang, p, m, count(*) AS a, string_split(p, ' ') AS ws FROM ({_grams}) GROUP BY lang, p, m HAVING count(*) >= 30),
c AS (SELECT f.*, k FROM f, (SELECT unnest([1, 2, 3]) AS k) WHERE k < m),
s AS (SELECT c.lang, c.p, c.m, c.a, c.k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a::HUGEINT + r.a))::BIGINT AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.p = array_to_string(c.ws[:c.k], ' ') JOIN f r ON r.lang = c.lang AND r.p = array_to_string(c.ws[c.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
i AS (SELECT lang, array_to_string(ws[j:j + h - 1], ' ') AS p, max(a) AS longer FROM f, (SELECT unnest([2, 3]) AS h), (SELECT unnest([1, 2, 3]) AS j) WHERE h < m AND j + h - 1 <= m GROUP BY 1, 2)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.p)) AS rank, b.p AS phrase, a, l, r, n.n, score
FROM b JOIN n USING (lang) LEFT JOIN i ON i.lang = b.lang AND i.p = b.p WHERE NOT coalesce(100::HUGEINT * longer >= 80::HUGEINT * a, false)
QUALIFY rank <= 2000
"""


@query(PHRASES_SQL)
def op12_phrases(spark: SparkSession, d: str) -> DataFrame:
    """Phrases of all documents, the first 2000 of each language."""
    return collocations.collocations(documents(spark, d, "doc_id", "lang", "text"))

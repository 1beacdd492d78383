"""The registered queries of the corpus operators, and the SQL of those it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from martloom.llm import pii
from martloom.llm.collocations import collocations, mine
from martloom.llm.fingerprints import with_edits
from martloom.llm.frames import table
from martloom.llm.language import held_out, identify
from martloom.llm.line_dedup import drop_repeated_lines
from martloom.llm.merkle import leaves, manifest, proved
from martloom.llm.near_dedup import near_duplicates
from martloom.llm.packing import pack
from martloom.llm.repeats import repeats
from martloom.llm.sentence_pieces import encode_and_check
from martloom.llm.sharding import sharded
from martloom.llm.token_rollup import TokenRollup, counted, default_versions
from martloom.llm.topk import search
from martloom.session import cut, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@register
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = """
    WITH lines AS (
        SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
        FROM documents
    ), keyed AS (
        SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
        FROM lines
    ), firsts AS (
        SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key
    ), marked AS (
        SELECT k.*, f.first IS NOT NULL AND f.first <> k.doc_id AS gone
        FROM keyed k LEFT JOIN firsts f ON k.key = f.key
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
           sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
    FROM marked GROUP BY doc_id
"""


@register
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


@register
def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


@register
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, 20)


ORACLES["op4_exact_topk"] = """
    WITH valid AS (
        SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
        FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
          AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), scored AS (
        SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
        FROM valid q JOIN valid c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
    FROM scored
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""


@register
def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@register
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs).withColumn("held_out", held_out(F.col("id")))
    return found.select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score", "rejected")


@register
def op7_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))


@register
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [
        F.size(F.filter("pii_base", pii.of_kind(i))).cast("bigint").alias(f"n_{kind}")
        for i, kind in enumerate(pii.KINDS)
    ]
    return found.select(
        "doc_id", *counts, F.sha2(pii.as_text("pii_base"), 256).alias("base_sha256"), pii.as_text("pii_spans").alias("spans")
    )


@register
def op9_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_and_check(table(spark, sf_dir, "documents"))


@register
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four batches by a hash of the id, one batch twice; then every
    document with a digit is revised to a text without digits, and every copy of a text but
    the one with the smallest id is deleted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    copy = F.xxhash64("text", F.lit("copy"))
    inserts = docs.select(F.lit("insert").alias("op"), F.lit(0).alias("seq"), "*")
    plain = F.regexp_replace("text", "[0-9]+", "")
    revised = docs.where(F.col("text").rlike("[0-9]")).select(
        F.lit("revise").alias("op"), F.lit(1).alias("seq"), "doc_id", plain.alias("text"), "lang", "source"
    )
    hashed = docs.select("doc_id", "lang", "source", copy.alias("copy"))
    firsts = hashed.groupBy("copy").agg(F.min("doc_id").alias("first"))
    gone = hashed.join(firsts, "copy").where("doc_id <> first").select(
        F.lit("delete").alias("op"), F.lit(2).alias("seq"), "doc_id", F.lit("").alias("text"), "lang", "source"
    )
    versions = default_versions()
    counts = cut(counted(inserts.unionByName(revised).unionByName(gone), versions), "counts", ("seq",))
    rollup = TokenRollup(spark, scratch_path(spark, "rollup"))
    arrival = F.pmod(F.xxhash64("doc_id"), F.lit(4))
    for n in (0, 1, 2, 1, 3):
        rollup.commit(f"insert-{n}", counts.where((F.col("seq") == 0) & (arrival == n)))
    rollup.commit("revise", counts.where("seq = 1"))
    rollup.commit("delete", counts.where("seq = 2"))
    return rollup.totals()


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One changed version for every document whose id's crc32 is a multiple of 7: n_chars is one more."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    more = F.col("n_chars").cast("decimal(38,0)") + 1  # one more than the greatest bigint is a number too
    docs = table(spark, sf_dir, "documents")
    return proved(manifest(leaves(docs, changes={"n_chars": more}, where=hit))).withColumnRenamed("id", "doc_id")


# The remainders of all bytes for the reflected polynomial of CRC-32.
SQL_CRC_TABLE = """
    crc_table AS MATERIALIZED (
        SELECT list_transform(range(256), lambda i: list_reduce(range(8),
               lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t
    )
"""


def sql_crc(bytes_list: str) -> str:
    """CRC-32 of a list of bytes, beside `crc_table`."""
    step = "lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])"
    return f"xor(list_reduce({bytes_list}, {step}, 4294967295), 4294967295)"


def sql_leaf(n_chars: str) -> str:
    parts = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode({p})) || ':' || {p}, '-')" for p in parts) + ")"


ORACLES["op11_merkle_manifest"] = f"""
    WITH RECURSIVE {SQL_CRC_TABLE}, leaves AS (
        SELECT coalesce('=' || lang, '') AS tree, doc_id, {sql_leaf("n_chars")} AS leaf,
               CASE WHEN {sql_crc("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)")} % 7 = 0
                    THEN {sql_leaf("n_chars::HUGEINT + 1")} ELSE {sql_leaf("n_chars")} END AS used,
               row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n
        FROM documents, crc_table
    ), nodes AS (
        SELECT tree, 0 AS level, pos, leaf AS h, n FROM leaves
        UNION ALL
        SELECT tree, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
        FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2
    ), subroots AS (
        SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS trees
        FROM nodes WHERE n = 1
    ), uppers AS (
        SELECT 0 AS level, place AS pos, subroot AS h, trees AS n FROM subroots
        UNION ALL
        SELECT level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), any_value((n + 1) // 2)
        FROM uppers WHERE n > 1 GROUP BY level, pos // 2
    ), climb AS (
        SELECT l.tree, l.pos AS leaf_pos, l.doc_id, 0 AS level, l.pos, l.used AS h, '' AS proof FROM leaves l
        UNION ALL
        SELECT c.tree, c.leaf_pos, c.doc_id, c.level + 1, c.pos // 2,
               sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END),
               c.proof || coalesce(s.h, '')
        FROM climb c JOIN nodes o ON o.tree = c.tree AND o.level = c.level AND o.pos = c.pos AND o.n > 1
        LEFT JOIN nodes s ON s.tree = c.tree AND s.level = c.level AND s.pos = xor(c.pos, 1)
    ), within AS (
        SELECT c.* FROM climb c JOIN nodes o ON o.tree = c.tree AND o.level = c.level AND o.n = 1
    ), rise AS (
        SELECT w.tree, w.leaf_pos, 0 AS level, s.place AS pos, w.h, w.proof FROM within w JOIN subroots s USING (tree)
        UNION ALL
        SELECT c.tree, c.leaf_pos, c.level + 1, c.pos // 2,
               sha256(CASE WHEN c.pos % 2 = 1 THEN s.h || c.h ELSE c.h || coalesce(s.h, '') END),
               c.proof || coalesce(s.h, '')
        FROM rise c JOIN uppers o ON o.level = c.level AND o.pos = c.pos AND o.n > 1
        LEFT JOIN uppers s ON s.level = c.level AND s.pos = xor(c.pos, 1)
    )
    SELECT l.doc_id, l.leaf, s.subroot, u.h AS root, sha256(r.proof) AS proof_sha256, r.h AS folded_root,
           r.h = u.h AS verified
    FROM rise r JOIN uppers u ON u.level = r.level AND u.n = 1
    JOIN leaves l ON l.tree = r.tree AND l.pos = r.leaf_pos JOIN subroots s ON s.tree = l.tree
"""


@register
def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(mine(table(spark, sf_dir, "documents")))


ORACLES["op12_phrase_collocations"] = """
    WITH pieces AS (
        SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece
        FROM documents WHERE text IS NOT NULL
    ), numbered AS (
        SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w
        FROM pieces
    ), grams AS (
        SELECT lang, m, list_aggregate(w[i:i + m - 1], 'string_agg', ' ') AS phrase
        FROM (SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM numbered, range(1, 6) t(m) WHERE len(w) >= m)
    ), totals AS (
        SELECT lang, count(*) AS n FROM grams WHERE m = 1 GROUP BY lang
    ), counts AS (
        SELECT lang, m, phrase, count(*) AS a FROM grams GROUP BY lang, m, phrase HAVING count(*) >= 100
    ), cuts AS (
        SELECT lang, phrase, m, a, k, list_aggregate(w[1:k], 'string_agg', ' ') AS first,
               list_aggregate(w[k + 1:], 'string_agg', ' ') AS rest
        FROM (SELECT *, string_split(phrase, ' ') AS w, unnest(range(1, m)) AS k FROM counts WHERE m > 1)
    ), weighed AS (
        SELECT c.lang, c.phrase, c.m, c.a, c.k, l.a AS l, r.a AS r, t.n,
               (1000::HUGEINT * c.a * t.n) // (l.a::HUGEINT * r.a) AS score
        FROM cuts c JOIN counts l ON l.lang = c.lang AND l.phrase = c.first
        JOIN counts r ON r.lang = c.lang AND r.phrase = c.rest JOIN totals t ON t.lang = c.lang
    ), weakest AS (
        SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
    ), kept AS (
        SELECT w.* FROM weakest w WHERE NOT EXISTS (
            SELECT 1 FROM weakest o WHERE o.lang = w.lang AND o.m > w.m AND o.a >= w.a
            AND contains(' ' || o.phrase || ' ', ' ' || w.phrase || ' '))
    )
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n,
           score::BIGINT AS score
    FROM kept QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


SHARDS = 24


@register
def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of equal weight; `grown_shard` with a 25th."""
    found = sharded(table(spark, sf_dir, "documents"), [1.0] * SHARDS, grown=1.0)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard"
    )


ORACLES["op13_sharding"] = f"""
    WITH {SQL_CRC_TABLE}, data AS (
        SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS x FROM documents
    ), bid AS (
        SELECT doc_id, s AS shard,
               -ln((('0x' || md5(coalesce(doc_id::VARCHAR, '') || ':' || s)[1:13])::BIGINT::DOUBLE + 0.5) / (1::BIGINT << 52)) AS cost
        FROM documents, range({SHARDS + 1}) t(s)
    ), won AS (
        SELECT doc_id, arg_min(shard, cost) FILTER (WHERE shard < {SHARDS}) AS shard, arg_min(shard, cost) AS grown_shard
        FROM bid GROUP BY doc_id
    )
    SELECT d.doc_id, octet_length(b) + 8 AS size,
           {sql_crc("list_transform(range(octet_length(b)), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)")} AS text_crc32,
           'key' AS law, shard::INT AS shard, row_number() OVER (PARTITION BY shard ORDER BY d.doc_id) - 1 AS slot,
           grown_shard::INT AS grown_shard
    FROM data d JOIN won w ON w.doc_id IS NOT DISTINCT FROM d.doc_id, crc_table
"""

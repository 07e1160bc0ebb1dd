"""The registered queries opN_<name>: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushframe.llm import ann, exactdedup, langid, linededup, minhash, mixing, packing, periodicity, quality, secrets, sharding, urlfilter, whitening
from hushframe.llm.common import own_folder, table

WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text a shard of op6 may hold.
SHARD_BYTES = 1 << 20


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(table(spark, sf_dir, "documents"), capacity=1024, separator=0)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = joined(F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(base, 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80).select("doc_id", "n_shingles", "component_id", "kept")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = mixing.copies(table(spark, sf_dir, "documents"), weights=(5, 2, 1), cap=3.0, share=1.0)
    return mixing.rows_taken(units).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken")).alias("taken"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), limit_bytes=SHARD_BYTES)


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(docs.filter(~held_out).select("text", "lang"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = linededup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda i: i.cast("string")), ",").alias("removed_lines"), F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urlfilter.judge(table(spark, sf_dir, "pages"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "strict_hits", "soft_hits", "weight")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, factor=1.0)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=16)


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exactdedup.DigestIndex(spark, own_folder(spark, "digests"))
    judged = exactdedup.judge(table(spark, sf_dir, "documents"), index, batch="documents", keep=("doc_id",))
    return judged.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodicity.periodic_runs(periodicity.planted(table(spark, sf_dir, "documents").select("doc_id", "text")))
    greatest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    found = found.withColumn("r", greatest)
    period = -F.col("r.short")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("r.back")).alias("start"), F.col("r.length").alias("length"), period.alias("period"),
        F.floor(1000 * F.col("r.length") / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Shortest runs of whole lines with at least WORDS words that start, and that end, at each line; those that occurred before go.
LINE_DEDUP_SQL = f"""
WITH lines AS (SELECT doc_id, i, string_split(text, chr(10))[i + 1] AS line FROM documents, unnest(range(0, len(string_split(text, chr(10))))) AS r(i) WHERE length(text) > 0),
solid AS (SELECT doc_id, i, array_to_string(regexp_extract_all(line, '{WORD}'), ' ') AS words, len(regexp_extract_all(line, '{WORD}')) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
placed AS (SELECT *, row_number() OVER w AS k, sum(n) OVER w AS upto FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
forward AS (SELECT a.doc_id, a.k AS k1, min(b.k) AS k2 FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= {linededup.WORDS} GROUP BY ALL),
backward AS (SELECT b.doc_id, max(a.k) AS k1, b.k AS k2 FROM placed a JOIN placed b ON a.doc_id = b.doc_id AND b.k >= a.k AND b.upto - a.upto + a.n >= {linededup.WORDS} GROUP BY b.doc_id, b.k),
spans AS (SELECT * FROM forward UNION SELECT * FROM backward),
runs AS (SELECT s.doc_id, k1, k2, string_agg(words, chr(10) ORDER BY k) AS run FROM spans s JOIN placed p ON s.doc_id = p.doc_id AND k BETWEEN k1 AND k2 GROUP BY ALL),
later AS (SELECT doc_id, k1, k2 FROM runs QUALIFY row_number() OVER (PARTITION BY run ORDER BY doc_id, k1) > 1),
gone AS (SELECT DISTINCT p.doc_id, p.i FROM later l JOIN placed p ON l.doc_id = p.doc_id AND k BETWEEN k1 AND k2),
-- lines without a word inside a deleted run go with it
holes AS (SELECT DISTINCT l.doc_id, l.i FROM later s JOIN placed a ON a.doc_id = s.doc_id AND a.k = k1 JOIN placed b ON b.doc_id = s.doc_id AND b.k = k2 JOIN lines l ON l.doc_id = s.doc_id AND l.i BETWEEN a.i AND b.i),
every AS (SELECT * FROM gone UNION SELECT * FROM holes),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS t FROM lines l ANTI JOIN every e ON l.doc_id = e.doc_id AND l.i = e.i GROUP BY l.doc_id),
dropped AS (SELECT doc_id, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS s FROM every GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN length(text) > 0 THEN len(string_split(text, chr(10))) ELSE 0 END::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, '') AS removed_lines,
    sha256(CASE WHEN n > 0 THEN coalesce(t, '') ELSE text END) AS kept_sha256
FROM documents d LEFT JOIN dropped USING (doc_id) LEFT JOIN kept USING (doc_id)"""

#: All pairs of sets that share a word pair, their exact similarity, and the components of the links.
MINHASH_SQL = f"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
grams AS MATERIALIZED (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS g FROM texts, unnest(range(1, len(w))) AS r(i) UNION ALL SELECT doc_id, w[1] FROM texts WHERE len(w) = 1),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS MATERIALIZED (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * c >= 80 * (s.n + t.n - c)),
edges AS MATERIALIZED (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, x AS other FROM edges UNION SELECT r.doc_id, e.y FROM reach r JOIN edges e ON r.other = e.x)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(c, t.doc_id) AS component_id, coalesce(c, t.doc_id) = t.doc_id AS kept
FROM texts t LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY doc_id) USING (doc_id)"""

#: The cosine of every query with every other vector.
ANN_SQL = """
WITH parts AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
good AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS v, len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL AND vec_id IN
    (SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x)) AND bool_or(x <> 0))),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(c.v, c.v))) AS score
    FROM good q JOIN good c ON q.dim = c.dim AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5"""


#: The largest doc_id of each text.
EXACT_DEDUP_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


def quality_sql(source: str = "documents") -> str:
    """The counts and verdicts of op3 over a relation with doc_id (one row each) and text."""
    stops = ", ".join(f"'{w}'" for w in sorted({w for words in quality.STOP_WORDS.values() for w in words}))
    return f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM {source}),
windows AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM texts, unnest(range(1, len(w) - 1)) AS r(i)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM again, (VALUES (0), (1), (2)) AS v(d) GROUP BY doc_id),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '{quality.SYMBOLS}'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words FROM texts LEFT JOIN covered USING (doc_id)),
base AS (SELECT *, NOT ({' AND '.join(r.sql() for r in quality.BASE_RULES)}) AS base_failed FROM counts)
SELECT *, NOT base_failed AND {' AND '.join(r.sql() for r in quality.RULES)} AS kept FROM base"""


def queries() -> dict:
    found = (op1_packing, op2_secrets, op3_quality, op4_minhash, op5_mixing, op6_sharding, op7_langid, op8_line_dedup, op9_url_filter, op10_ann, op11_whitening, op12_exact_dedup, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL where it can express the query; the others are tested against brute force in tests/llm."""
    return {"op3_quality": quality_sql(), "op4_minhash": MINHASH_SQL, "op8_line_dedup": LINE_DEDUP_SQL, "op9_url_filter": urlfilter.oracle_sql(), "op10_ann": ANN_SQL, "op12_exact_dedup": EXACT_DEDUP_SQL}

"""Registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sigflow.llm import decontaminate, extract, fingerprints, jaccard, language, lines, mixing, passages, repeats, topk, toxicity, variants, warc
from sigflow.llm.common import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    out = mixing.plan_copies(cut(docs))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 100 == 0)).select("query_id", "rank", "vec_id", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = warc.write_warc(table(spark, sf_dir, "pages"))
    out = warc.records(warc.read_chunks(segments))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, model)
    return out.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_tokens", "toxic_spans")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find_repeats(table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = language.train(table(spark, sf_dir, "documents"))
    return language.identify_pages(table(spark, sf_dir, "pages"), model)


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "text", "n_lines", "n_removed")


def with_third_of(text: str, after: str) -> str:
    """The text with its last third replaced by the beginning of the next one."""
    third = len(text) // 3
    return text[: len(text) - third] + after[:third]


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_next(table(spark, sf_dir, "documents"), with_third_of)


def with_period(doc_id: Column, text: Column) -> Column:
    """The texts of a tenth of the documents, by the CRC of the id, become periodic from some word on; the others stay, those
    without an id too."""
    n, g = F.size, F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)

    def periodic(words: Column, g: Column) -> Column:
        a = g % n(words)
        p = 1 + F.floor((n(words) - a) / (3 + g % 8))
        place = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0), n(words) - 1), lambda i: F.element_at(words, (place(i) + 1).cast("int"))), " ")

    once = F.array(F.struct(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")).alias("words"), g.alias("g")))  # made once, not for each word
    made = F.transform(once, lambda x: F.when(n(x["words"]) > 0, periodic(x["words"], x["g"])))[0]
    return F.coalesce(F.when(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, made), text)


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", with_period(F.col("doc_id"), F.col("text")).alias("text"))
    runs = F.col("runs")
    by_length = F.transform(runs, lambda x: F.struct(-x["length"], x["start"], x["period"]))
    best = F.array_min(by_length)
    lines = F.array_join(F.transform(runs, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
    out = repeats.find_runs(docs).withColumn("best", F.struct(best["start"].alias("start"), (-best["col1"]).alias("length"), best["period"].alias("period")))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.*", exponent, F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))


def spoiled(doc_id: object, run: str) -> str:
    """The run less one letter, if 199 divides the CRC of the id and the run; runs of documents without an id stay."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    return run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.count_words(table(spark, sf_dir, "documents"), "A-Za-z\u00C0-\u00FF", 6, spoiled)
    return variants.spelling_variants(words.where("n >= 5"))


QUERIES = {"op1_decontaminate": op1_decontaminate, "op2_mix": op2_mix, "op3_topk": op3_topk, "op4_jaccard_join": op4_jaccard_join, "op5_warc": op5_warc, "op6_toxicity": op6_toxicity, "op7_passages": op7_passages, "op8_language": op8_language, "op9_extract": op9_extract, "op10_line_dedup": op10_line_dedup, "op11_fingerprints": op11_fingerprints, "op12_repeats": op12_repeats, "op13_variants": op13_variants}

OP2_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight, 3.0::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER r, 0) AS closed, sum(weight) OVER q AS open_weight, (SELECT sum(source_size) FROM s) AS total
      FROM w WINDOW r AS (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT max((total - closed) / open_weight) FILTER (WHERE cap > weight * ((total - closed) / open_weight)) AS lvl FROM o),
t AS (SELECT source, source_size, CASE WHEN lvl IS NULL THEN cap ELSE least(cap, weight * lvl) END AS target FROM w, l),
k AS (SELECT d.*, source_size, target, row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS LAST) AS rnk,
      CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS each
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(c * size AS BIGINT) AS taken, CAST(c AS INTEGER) AS copies
FROM (SELECT *, floor(rnk * each + {mixing.offset_of()!r}) - floor((rnk - 1) * each + {mixing.offset_of()!r}) AS c FROM k)
"""

OP3_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: coalesce(z[1] * z[2], 0))) AS BIGINT) AS score FROM v q, v c WHERE q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
h AS (SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS first_id FROM p),
b AS (SELECT *, list_transform(range(8), lambda i: CAST('0x' || substr(hex, CAST(1 + 5 * i AS INT), 5) AS INT)) AS parts FROM h)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(parts, lambda v: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 15) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31), 1)
    || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31), 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM b
"""

OP10_SQL = """
WITH l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL),
t AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare FROM l),
bad AS (SELECT bare FROM t WHERE bare <> '' GROUP BY bare HAVING count(DISTINCT coalesce('=' || source, 'null')) >= 10),
r AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE b.bare IS NULL), '') AS text, count(*) AS n_lines, count(b.bare) AS n_removed
      FROM t LEFT JOIN bad b ON t.bare = b.bare GROUP BY doc_id)
SELECT d.doc_id, r.text, CAST(coalesce(r.n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(r.n_removed, 0) AS INTEGER) AS n_removed FROM documents d LEFT JOIN r USING (doc_id)
"""

ORACLE = {"op2_mix": OP2_SQL, "op3_topk": OP3_SQL, "op5_warc": OP5_SQL, "op10_line_dedup": OP10_SQL}

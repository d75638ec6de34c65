"""The training-data operators as queries over the driver's tables, with their parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import attribution, jaccard, langid, licenses, mixing, neighbours, packing, quality, suffix, token_files, tokens


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(_docs(spark, sf_dir), tokens.default_path())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), tokens.default_path())


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir)).drop("detections")


def op4_jaccard_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_docs(spark, sf_dir))


#: Rows that nothing may be learned from.
HELD_OUT = "coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)"
#: Labelled rows of each language that the classifiers are fitted on, about.
TRAIN_PER_LANG = 800


def lang_model(docs: DataFrame) -> langid.Model:
    return langid.fit(langid.training_sample(docs, f"not ({HELD_OUT})", TRAIN_PER_LANG, "doc_id", "text", "lang"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    found = langid.identify(docs.select("doc_id", "text"), lang_model(docs))
    return found.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "lang_pred", "score", "ambiguous")


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_files.token_file_folder(spark)
    manifest = token_files.write_token_files(_docs(spark, sf_dir), folder, tokens.default_path())
    return token_files.read_token_files(spark, folder, manifest)


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 20 = 0")


def op8_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.clean_lines(_docs(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_failed_lines")


def op9_remove_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_docs(spark, sf_dir), keep="text").withColumnRenamed("kept", "text")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_docs(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op")}


#: Lower-cased words of each document, by row.
_WORDS = "t AS (SELECT row_number() OVER () AS rn, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents), w AS (SELECT rn, doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM t)"
#: Distinct shingles, links of rows that hold enough of the same, and the least id that links reach.
OP4_SQL = f"""WITH RECURSIVE {_WORDS},
s AS (SELECT DISTINCT rn, hash(list_aggregate(w[i : i + least(len(w), 4) - 1], 'string_agg', ' ')) AS h FROM w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS u(i) WHERE len(w) > 0),
n AS (SELECT rn, count(*) AS n FROM s GROUP BY 1),
b AS (SELECT x.rn AS a, y.rn AS b, count(*) AS m FROM s x JOIN s y ON x.h = y.h AND x.rn < y.rn GROUP BY 1, 2),
e AS (SELECT a, b FROM b JOIN n p ON p.rn = a JOIN n q ON q.rn = b WHERE 100 * m >= 85 * (p.n + q.n - m)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
c(a, b) AS (SELECT rn, rn FROM w UNION SELECT c.a, u.b FROM c JOIN u ON u.a = c.b)
SELECT any_value(w.doc_id) AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id
FROM c JOIN w ON w.rn = c.a JOIN w o ON o.rn = c.b LEFT JOIN n ON n.rn = c.a GROUP BY c.a"""
#: Every string of 400 bytes in hexadecimal digits, by a hash of 128 bits; runs of covered bytes; what lies between them.
OP9_SQL = """WITH t AS (SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), d AS (SELECT *, len(h) // 2 AS n FROM t),
w AS (SELECT rn, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM d, unnest(range(n - 399)) AS u(i) WHERE n >= 400),
r AS (SELECT rn, i FROM w WHERE k IN (SELECT k FROM w GROUP BY k HAVING count(*) > 1)),
g AS (SELECT rn, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rn ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM r),
v AS (SELECT rn, i, sum(fresh) OVER (PARTITION BY rn ORDER BY i) AS k FROM g),
s AS (SELECT rn, k, min(i) AS lo, max(i) + 400 AS hi FROM v GROUP BY 1, 2),
gaps AS (SELECT rn, k, lo, coalesce(lag(hi) OVER (PARTITION BY rn ORDER BY lo), 0) AS from_ FROM s UNION ALL SELECT d.rn, 1e9::BIGINT, any_value(d.n), coalesce(max(s.hi), 0) FROM d LEFT JOIN s ON s.rn = d.rn GROUP BY d.rn),
p AS (SELECT gaps.rn, gaps.from_, substr(h, 2 * from_ + 1, 2 * (lo - from_)) AS x FROM gaps JOIN d ON d.rn = gaps.rn),
q AS (SELECT rn, string_agg(x, '' ORDER BY from_) AS kept, string_agg(regexp_replace(regexp_replace(x, '^([89AB][0-9A-F])+', ''), '([CD][0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-7]([89AB][0-9A-F]){0,2})$', ''), '' ORDER BY from_) AS clean FROM p GROUP BY rn),
c AS (SELECT rn, sum(hi - lo) AS gone, count(*) AS spans FROM s GROUP BY rn)
SELECT d.doc_id, d.n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256, decode(unhex(clean)) AS text FROM d JOIN q USING (rn) LEFT JOIN c USING (rn)"""


def oracle_sql() -> dict[str, str]:
    """For op4 and op9, whose results are exact; op3 and op8 hold expressions that differ between engines, the others draws, models or the tokenizer."""
    return {"op4_jaccard_groups": OP4_SQL, "op9_remove_repeats": OP9_SQL}

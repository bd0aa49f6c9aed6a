"""The registered queries of this subpackage: thin digests of the operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respan.llm.util import crc_mod, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.language_id import identify

    held = crc_mod("doc_id", 4) == 2
    out = identify(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.pii import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.packing import pack
    from respan.llm.util import tokenizer_path

    return pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.sharding import shard

    return shard(table(spark, sf_dir, "documents"))


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.substrings import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.toxicity import score

    held = crc_mod("doc_id", 5) == 0
    out = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held)
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")


@query
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.decontamination import leaks

    out = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", "tokens", "item_tokens")


@query
def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.winnowing import compare_with_edits

    return compare_with_edits(table(spark, sf_dir, "documents"))


@query
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.language_model import score

    held = crc_mod("doc_id", 5) == 1
    out = score(table(spark, sf_dir, "documents"), ~held)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op11_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.token_ids import through_files
    from respan.llm.util import tokenizer_path

    out = through_files(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.fim import restored, transform

    out = transform(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"))


def _repeat_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in every tenth document by hash, the words from the a-th on become
    repeats of the p words there (the test input that the query's contract states)."""
    h = crc_mod("doc_id", 1 << 32)
    g = F.floor(h / 10)
    docs = docs.select("doc_id", "text", h.alias("h"), g.alias("g"),
                       F.expr(r"filter(split(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+'), x -> x <> '')").alias("words"))
    docs = docs.withColumn("n", F.size("words")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
    docs = docs.withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)"))
    tail = F.expr("slice(flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    changed = F.array_join(F.concat(F.expr("slice(words, 1, a)"), tail), " ")
    return docs.select("doc_id", F.when(F.expr("h % 10 = 0 and n > 0"), changed).otherwise(F.col("text")).alias("text"))


@query
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from respan.llm.periodic import find_runs

    out = find_runs(_repeat_tails(table(spark, sf_dir, "documents")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    best = F.col("greatest")
    return out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"),
                      best.period.alias("period"), F.expr("greatest.length * 1000 div greatest.period").alias("exponent_milli"),
                      F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


ORACLE["op10_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t
           FROM documents),
p AS (SELECT doc_id, t, unnest(range(1, len(t) - 11)) AS i FROM w),
g AS (SELECT doc_id, i, array_to_string(list_slice(t, i, i + 12), ' ') AS gram FROM p),
f AS (SELECT gram, min(doc_id) AS first_doc FROM g GROUP BY gram),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN f USING (gram), range(0, 13) r(k) WHERE first_doc < doc_id),
words AS (SELECT doc_id, unnest(t) AS word, generate_subscripts(t, 1) AS pos FROM w),
kept AS (SELECT words.doc_id, count(*) FILTER (WHERE gone.pos IS NOT NULL) AS n_removed,
                string_agg(word, ' ' ORDER BY words.pos) FILTER (WHERE gone.pos IS NULL) AS text
         FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos GROUP BY words.doc_id)
SELECT w.doc_id, CAST(len(t) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

ORACLE["op12_fill_in_middle"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
                  sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, text, u, CAST(len(u) AS BIGINT) AS n, CAST('0x' || x[1:8] AS BIGINT) AS h1, CAST('0x' || x[9:16] AS BIGINT) AS h2,
             CAST('0x' || x[17:24] AS BIGINT) AS h3, CAST('0x' || x[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR h3 % 100 >= 90 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(list_slice(u, 1, a), ''), '') AS pre,
             coalesce(array_to_string(list_slice(u, a + 1, b), ''), '') AS mid,
             coalesce(array_to_string(list_slice(u, b + 1, n), ''), '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
              ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256 FROM p
"""

# crc32 by bits; words q apart are matched through their 3-grams (a run has at least three equal pairs in a row)
ORACLE["op13_periodic_runs"] = r"""
WITH c AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS t,
                  xor(4294967295, list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: CAST(ascii(d) AS BIGINT)),
                      lambda c, b: list_reduce(range(8), lambda x, k: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b)),
                      4294967295)) AS h
           FROM documents),
n AS (SELECT doc_id, t, CAST(len(t) AS BIGINT) AS n, h, h // 10 AS g FROM c),
a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM n),
p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
w AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
             THEN list_transform(range(n), lambda i: t[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE t END AS t FROM p),
words AS (SELECT doc_id, n, unnest(t) AS word, generate_subscripts(t, 1) - 1 AS i FROM w),
grams AS (SELECT doc_id, n, i, word || ' ' || lead(word) OVER s || ' ' || lead(word, 2) OVER s AS gram FROM words
          WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
pairs AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM grams x JOIN grams y ON y.doc_id = x.doc_id AND y.gram = x.gram
          WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS isle FROM pairs),
stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM marked GROUP BY doc_id, q, isle),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
per AS (SELECT doc_id, count(*) AS n_runs, first({'s': start, 'l': length, 'p': period} ORDER BY length / period DESC, start, period) AS best,
               string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT words.doc_id, string_agg(word, ' ' ORDER BY words.i) AS text FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i
         WHERE gone.i IS NULL GROUP BY words.doc_id)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period,
       best.l * 1000 // best.p AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM w LEFT JOIN per ON per.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""

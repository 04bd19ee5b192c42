"""The registered query of each operator, on its whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import cut_lineage, scratch_path, table
from .context_tree import tree_scores
from .decontaminate import contained_items
from .html_text import main_text
from .importance import resample
from .jaccard_join import jaccard_components
from .packing import pack_documents
from .phrases import collocations
from .pii import KINDS, personal_spans
from .quality_rules import quality_verdicts
from .record_files import read_records, write_records
from .registry import query
from .rule_ensemble import quality_scores
from .suffix_dedup import remove_repeats
from .token_rollup import Rollup, deletes, inserts, revisions, token_counts
from .unigram import unigram_scores


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_best_fit_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 2048, keep_ids=False)


@query("op9_ngram_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=5, percent=75)


@query("op10_suffix_array_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), length=100, keep_text=False)


WORD = r"[^\x20\x09-\x0D]+"

OP2_SQL = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, w[p:p + least(len(w), 5) - 1] AS s
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY 1),
k AS (SELECT DISTINCT k FROM i),
d AS (SELECT DISTINCT doc_id, k, w[p:p + k - 1] AS s
      FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, k WHERE len(w) >= k))
SELECT doc_id, item_id, n_item, count(*) AS n_shared
FROM i JOIN d USING (k, s) JOIN n USING (item_id) GROUP BY ALL HAVING 100 * count(*) >= 75 * n_item
"""


@query("op2_benchmark_decontamination", OP2_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=5, percent=75)


OP3_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{WORD}') AS w FROM t),
x AS (SELECT r, p, w[p:p + 2] AS s FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM w)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, s) AS c FROM x) WHERE c > 1),
rep AS (SELECT r, count(DISTINCT p + o) AS n FROM twice, (VALUES (0), (1), (2)) v(o) GROUP BY 1),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM t) WHERE regexp_matches(line, '{WORD}') GROUP BY 1),
s AS (SELECT t.r, doc_id, source, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
        (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(l.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
      FROM t JOIN w USING (r) LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
        1000 * n_symbols > 100 * n_words OR 1000 * n_dup_lines > 20 * n_words
          OR 1000 * word_chars < 3000 * n_words OR 1000 * word_chars > 10000 * n_words AS mild,
        1000 * n_symbols > 300 * n_words OR 1000 * n_dup_lines > 50 * n_words
          OR 1000 * word_chars < 2000 * n_words OR 1000 * word_chars > 16000 * n_words AS severe FROM s),
h AS (SELECT source, count(*) AS n, sum((base_failed OR mild)::INT) AS f FROM j GROUP BY 1),
m AS (SELECT avg(f / n) AS m, var_pop(f / n) AS v, avg(1.0 / n) AS i FROM h),
p AS (SELECT m, greatest(m * (1 - m) / greatest(v - m * (1 - m) * i, 1e-6) - 1, 1.0) AS s FROM m),
q AS (SELECT source, (f + m * s) / (n + s) > 0.5 AS strict FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (CASE WHEN strict THEN mild ELSE severe END) AS kept
FROM j JOIN q ON j.source IS NOT DISTINCT FROM q.source
"""


@query("op3_host_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).drop("strict")


def fold(id_col: str, n: int):
    """crc32 of the id as text, modulo n: the split that the contracts fix."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


@query("op8_rule_ensemble_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(fold("doc_id", 3) != 1)
    scored = quality_scores(table(spark, sf_dir, "documents"), labels)
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def joined_spans(spans: str):
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def of_kind(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")


@query("op4_candidate_boosted_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", *[of_kind("base", k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined_spans("base"), 256).alias("base_sha256"), joined_spans("spans").alias("spans"))


@query("op6_context_tree_scores")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = docs.withColumns({"uid": F.xxhash64("doc_id", "text"), "train": fold("doc_id", 10) != 0})
    # one pass over the texts at a time: each has its own table in memory
    base = cut_lineage(unigram_scores(rows))
    scores = cut_lineage(tree_scores(rows.select("uid", "text"), rows.where("train").select("text"), depth=4))
    return (rows.select("doc_id", "uid", (~F.col("train")).alias("held_out")).join(base, "uid").join(scores, "uid")
            .select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"))


@query("op5_dom_boosted_text")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


@query("op7_token_rollup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three batches: every document under one vocabulary; toxic documents deleted; the
    other languages than English recounted with a vocabulary for many. The last batch is
    committed twice, as after a retry."""
    docs = table(spark, sf_dir, "documents")
    versions = {"byte_bpe": tokenizer_path(), "byte_bpe_multi": tokenizer_path("byte_bpe_multi_50k.tiktoken")}
    counted = cut_lineage(token_counts(docs, versions, skip={"byte_bpe_multi": "en"}))
    first, second = (counted.where(F.col("tokenizer") == v) for v in versions)
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id").distinct()
    left = first.join(toxic, "doc_id", "left_anti")
    book = Rollup(spark, scratch_path(spark, "rollup"))
    book.commit("1-insert", inserts(first))
    book.commit("2-delete", deletes(first.join(toxic, "doc_id", "left_semi")))
    foreign = left.where("lang IS NULL OR lang <> 'en'")
    for _ in range(2):
        book.commit("3-revise", revisions(foreign, second.join(toxic, "doc_id", "left_anti")))
    return book.totals()


@query("op11_importance_resampling")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, least_words=20, seed=42)


@query("op13_token_records")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-records")
    write_records(table(spark, sf_dir, "documents"), folder, tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return read_records(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


OP12_SQL = r"""
WITH t AS (SELECT coalesce(lang, 'und') AS lang,
             unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
           FROM documents WHERE text IS NOT NULL),
p AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM t),
w AS (SELECT id, lang, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS w FROM p),
s AS (SELECT lang, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY id ORDER BY pos)),
g AS (SELECT lang, 1 AS k, w AS phrase FROM s UNION ALL SELECT lang, 2, w || ' ' || w2 FROM s WHERE w2 IS NOT NULL
      UNION ALL SELECT lang, 3, w || ' ' || w2 || ' ' || w3 FROM s WHERE w3 IS NOT NULL),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= 10),
x AS (SELECT c.lang, c.phrase, c.a, j, l.a AS l, r.a AS r, (1000000::HUGEINT * c.a * c.a) // (l.a * r.a) AS score
      FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
      JOIN f l ON l.lang = c.lang AND l.k = j AND l.phrase = array_to_string(w[1:j], ' ')
      JOIN f r ON r.lang = c.lang AND r.k = c.k - j AND r.phrase = array_to_string(w[j + 1:c.k], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
i AS (SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM c WHERE k = 3
      UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM c WHERE k = 3),
m AS (SELECT lang, phrase, max(a) AS longer FROM i GROUP BY ALL),
o AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank
      FROM b LEFT JOIN m ON m.lang = b.lang AND m.phrase = b.phrase WHERE 100 * coalesce(longer, 0) < 50 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM o JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op12_phrase_collocations", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), least=10, cover_percent=50, top=2000)

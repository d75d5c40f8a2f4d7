"""Registered queries on rows: text functions, loaders, cleaning, alignment, prompts and parsing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paravane.functions import parsers, prompts
from paravane.functions import text as T
from paravane.operators import align, clean
from paravane.plans import augment, harness
from paravane.plans.harness import COLLAPSED, PREDICTIONS_SQL, RAW_SQL, SPACE, TASKS_SQL, table
from paravane.schemas import VARIANTS
from paravane.sources import tasks as loaders

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def take(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return take


# -- text functions ---------------------------------------------------------
@query(f"SELECT doc_id, {COLLAPSED} AS x FROM documents")
def p1_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalize(["nfc", "collapse_whitespace"], F.col("text")).alias("x"))


WORDS_SQL = f"SELECT doc_id, source, CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END AS n_words FROM (SELECT doc_id, source, trim(regexp_replace(text, '{SPACE}', ' ', 'g')) AS x FROM documents)"


@query(f"SELECT doc_id, CAST(n_words AS INTEGER) AS n_words FROM ({WORDS_SQL}) WHERE n_words BETWEEN 10 AND 100")
def p4_length_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").filter(clean.in_band(10, 100, "text"))
    return docs.select("doc_id", T.word_count(T.collapse_whitespace(F.col("text"))).alias("n_words"))


@query("SELECT doc_id, substr(sha256(text), 1, 16) AS text_hash, substr(sha256(source || chr(30) || text), 1, 16) AS prompt_hash FROM documents")
def p6_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.short_hash(F.col("text")).alias("text_hash"), T.short_hash(F.col("source"), F.col("text")).alias("prompt_hash"))


TOKENS_SQL = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


@query(f"""SELECT page_id, CAST(len(t) AS INTEGER) AS n_tokens, CAST(len(list_distinct(t)) AS INTEGER) AS n_distinct
FROM (SELECT page_id, {TOKENS_SQL.format('html')} AS t FROM pages)""")
def p20_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", T.tokens(F.col("html")).alias("t"))
    return pages.select("page_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


@query(f"""WITH t AS (SELECT conv_id, turn, {TOKENS_SQL.format('text')} AS t FROM conversations WHERE turn < 2),
w AS (SELECT a.conv_id, list_distinct(a.t) AS a, list_distinct(b.t) AS b, len(b.t) - len(a.t) AS d FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
s AS (SELECT conv_id, d, len(list_intersect(a, b)) AS n, len(list_distinct(list_concat(a, b))) AS u FROM w)
SELECT conv_id, round(CASE WHEN u = 0 THEN 1.0 ELSE n / CAST(u AS DOUBLE) END, 9) AS jaccard, CAST(d AS INTEGER) AS token_delta FROM s""")
def p21_token_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", T.tokens(F.col("text")).alias("t"))
    first, second = (turns.filter(F.col("turn") == k).select("conv_id", F.col("t").alias(name)) for k, name in ((0, "a"), (1, "b")))
    both = first.join(second, "conv_id")
    return both.select("conv_id", F.round(T.token_jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), (F.size("b") - F.size("a")).alias("token_delta"))


# -- metadata and prompts ---------------------------------------------------
@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def p8_parse_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return events.select("event_id", prompts.parse_meta(F.col("props"), "k BIGINT")["k"].alias("k"))


@query("""SELECT doc_id, CASE WHEN abs(i) > len(c) OR i >= len(c) THEN '' WHEN i < 0 THEN c[len(c) + i + 1] ELSE c[i + 1] END AS choice
FROM (SELECT doc_id, [source, lang, CAST(n_chars AS VARCHAR)] AS c, CAST(doc_id % 9 - 4 AS INTEGER) AS i FROM documents)""")
def p9_choice_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct(F.array("source", "lang", F.col("n_chars").cast("string")).alias("choices"))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.choice_text(meta, (F.col("doc_id") % 9 - 4).cast("int")).alias("choice"))


@query(f"""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'Answer choices:' || chr(10) || 'A) ' || source || chr(10) || 'B) ' || lang END AS a,
  CASE WHEN doc_id % 3 = 0 THEN '{prompts.HYPOTHESIS_NOTE.replace("'", "''")}' || source END AS b, CASE WHEN doc_id % 5 = 0 THEN 'Gold label in words: ' || lang END AS c FROM documents)
SELECT doc_id, CASE WHEN coalesce(a, b, c) IS NULL THEN '' ELSE concat_ws(chr(10) || chr(10), a, b, c) || chr(10) || chr(10) END AS context FROM m""")
def p10_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    some = lambda k, c: F.when(F.col("doc_id") % k == 0, c)
    meta = F.struct(some(2, F.array("source", "lang")).alias("choices"), some(3, F.col("source")).alias("hypothesis"), some(5, F.col("lang")).alias("label_name"))
    return docs.select("doc_id", prompts.render_context(meta).alias("context"))


@query(f"""SELECT doc_id, 'system' AS first_role, '{prompts.SENTIMENT_SYSTEM.replace("'", "''")}' AS system, 'Sentence: ' || source || ' {{x}}' || chr(10) || 'Answer:' AS sentiment,
'Question: ' || source || chr(10) || 'A. ' || lang || chr(10) || 'B. b' || chr(10) || 'C. c' || chr(10) || 'D. d' || chr(10) || 'Answer:' AS choice,
'Premise: ' || source || chr(10) || 'Hypothesis: ' || lang || chr(10) || 'Answer:' AS pair FROM documents""")
def p12_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    meta = F.struct(F.array(F.col("lang"), F.lit("b"), F.lit("c"), F.lit("d")).alias("choices"), F.col("lang").alias("hypothesis"))
    sentiment = prompts.sentiment_messages(F.concat("source", F.lit(" {x}")))
    content = lambda chat: F.element_at(chat, 2)["content"]
    return docs.select(
        "doc_id",
        F.element_at(sentiment, 1)["role"].alias("first_role"),
        F.element_at(sentiment, 1)["content"].alias("system"),
        content(sentiment).alias("sentiment"),
        content(prompts.choice_messages(F.col("source"), meta)).alias("choice"),
        content(prompts.pair_messages(F.col("source"), meta)).alias("pair"),
    )


# -- parsers ----------------------------------------------------------------
@query(f"WITH {PREDICTIONS_SQL} SELECT dataset, model_id, id, variant, parsed, parse_status, correct FROM predictions")
def p14_sentiment_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.predictions(spark, sf_dir).select("dataset", "model_id", "id", "variant", "parsed", "parse_status", "correct")


@query(r"""WITH a AS (SELECT doc_id, upper(CASE WHEN contains(text, '</think>') THEN substr(text, instr(text, '</think>') + 8) ELSE text END) AS s FROM documents),
m AS (SELECT doc_id, regexp_extract(s, '(?:^|[^\p{L}\p{N}_])([A-D])(?:$|[^\p{L}\p{N}_])', 1) AS letter FROM a)
SELECT doc_id, CASE WHEN letter <> '' THEN CAST(ascii(letter) - 65 AS VARCHAR) END AS parsed FROM m""")
def p16_choice_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", parsers.parse_choice(F.col("text")).alias("parsed"))


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Neutral, no entailment' WHEN 1 THEN 'CONTRADICTION' WHEN 2 THEN '<think>neutral</think>entailment' WHEN 3 THEN text ELSE '' END AS raw FROM documents),
s AS (SELECT doc_id, lower(CASE WHEN contains(raw, '</think>') THEN substr(raw, instr(raw, '</think>') + 8) ELSE raw END) AS s FROM a),
p AS (SELECT doc_id, instr(s, 'entailment') AS e, instr(s, 'neutral') AS n, instr(s, 'contradiction') AS c FROM s),
f AS (SELECT doc_id, list_min(list_filter([struct_pack(at := e, code := '0'), struct_pack(at := n, code := '1'), struct_pack(at := c, code := '2')], lambda z: z.at > 0)) AS f FROM p)
SELECT doc_id, f.code AS parsed FROM f""")
def p15_relation_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 5
    raw = F.when(k == 0, "Neutral, no entailment").when(k == 1, "CONTRADICTION").when(k == 2, "<think>neutral</think>entailment").when(k == 3, F.col("text")).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", parsers.parse_relation(raw).alias("parsed"))


@query("""WITH a AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'PASS' WHEN 1 THEN 'fail.' WHEN 2 THEN 'maybe' WHEN 3 THEN 'pass or fail' WHEN 4 THEN '' ELSE 'I say Pass' END AS raw FROM documents),
b AS (SELECT doc_id, contains(upper(raw), 'PASS') AS y, contains(upper(raw), 'FAIL') AS n FROM a)
SELECT doc_id, y AND NOT n AS passed, CASE WHEN y AND NOT n THEN 'PASS' WHEN n AND NOT y THEN 'FAIL' ELSE 'MALFORMED' END AS verdict FROM b""")
def p17_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 6
    raw = F.when(k == 0, "PASS").when(k == 1, "fail.").when(k == 2, "maybe").when(k == 3, "pass or fail").when(k == 4, "").otherwise("I say Pass")
    return table(spark, sf_dir, "documents").select("doc_id", parsers.parse_verdict(raw).alias("v")).select("doc_id", "v.*")


# -- loaders ----------------------------------------------------------------
@query(f"""SELECT substr(sha256({COLLAPSED}), 1, 16) AS id, text AS x, CAST(quality AS VARCHAR) AS y, '{{}}' AS meta, CASE WHEN d.doc_id % 2 = 0 THEN 0 ELSE 1099511627776 END + d.doc_id AS row_idx
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def s1_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("text").alias("sentence"), F.col("quality").alias("label"), F.col("doc_id").alias("row_idx"))
    return loaders.sentences([rows.filter("row_idx % 2 = 0"), rows.filter("row_idx % 2 = 1")])


@query("SELECT source || '/' || CAST(doc_id AS VARCHAR) AS id, text AS x, CAST(doc_id % 4 AS VARCHAR) AS y, lang AS first_choice, doc_id AS row_idx FROM documents")
def s2_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("source").alias("subject"), F.col("text").alias("question"), F.array("lang", "source").alias("choices"), (F.col("doc_id") % 4).alias("answer"), F.col("doc_id").alias("row_idx"))
    return loaders.choices(rows).select("id", "x", "y", F.element_at(prompts.parse_meta(F.col("meta"))["choices"], 1).alias("first_choice"), "row_idx")


@query("""WITH r AS (SELECT *, (conv_id + turn) % 5 - 1 AS label, CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END AS split_ord FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY split_ord, turn) AS rn FROM r WHERE label BETWEEN 0 AND 2)
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, text AS x, CAST(label AS VARCHAR) AS y, CASE label WHEN 0 THEN 'entailment' WHEN 1 THEN 'neutral' ELSE 'contradiction' END AS label_name, role AS hypothesis FROM k WHERE rn = 1""")
def s3_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("pairID"), F.col("conv_id").alias("promptID"), F.col("text").alias("premise"), F.col("role").alias("hypothesis"), F.lit("g").alias("genre"), ((F.col("conv_id") + F.col("turn")) % 5 - 1).alias("label"), F.col("turn").alias("row_idx")
    )
    found = loaders.pairs([rows.filter("row_idx % 2 = 0"), rows.filter("row_idx % 2 = 1")])
    meta = prompts.parse_meta(F.col("meta"))
    return found.select("id", "x", "y", meta["label_name"].alias("label_name"), meta["hypothesis"].alias("hypothesis"))


# -- cleaning ---------------------------------------------------------------
OPTIONS = clean.CleanOptions(min_words=10, max_words=400, seed=7, max_rows=150)


def clean_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("x"), F.col("lang").alias("y"), F.lit("{}").alias("meta"), F.col("doc_id").alias("row_idx"))


CLEAN_SQL = f"""n AS (SELECT doc_id, lang AS y, {COLLAPSED} AS x FROM documents),
band AS (SELECT * FROM n WHERE CASE WHEN x = '' THEN 0 ELSE len(string_split(x, ' ')) END BETWEEN 10 AND 400),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY doc_id) AS rn FROM band) WHERE rn = 1)"""


@query(f"WITH {CLEAN_SQL} SELECT CAST(doc_id AS VARCHAR) AS id, x, y, '{{}}' AS meta, doc_id AS row_idx FROM once ORDER BY sha256('7' || chr(30) || CAST(doc_id AS VARCHAR) || chr(30) || CAST(doc_id AS VARCHAR)), id LIMIT 150")
def c1_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole cleaning stage: normalise, band, keep-first dedupe, seeded order, cap."""
    return clean.clean(clean_input(spark, sf_dir), OPTIONS)


@query(f"""WITH {CLEAN_SQL}, c AS (SELECT (SELECT count(*) FROM n) AS a, (SELECT count(*) FROM band) AS b, (SELECT count(*) FROM once) AS d)
SELECT a AS raw_loaded, a AS after_normalize, b AS after_length_filter, d AS after_dedupe, least(d, 150) AS after_shuffle_and_cap, least(d, 150) AS written FROM c""")
def a1_step_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.step_counts(clean_input(spark, sf_dir), OPTIONS)


@query("SELECT doc_id, text, lang FROM (SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def t2_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.keep_first(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), ["text", "lang"], ["doc_id"])


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role <> 'system') WHERE rn = 1")
def t3_keep_first_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").filter("role <> 'system'").select("conv_id", "turn", "role")
    return clean.keep_first(rows, ["conv_id"], ["turn"])


@query("SELECT doc_id, sha256('3' || chr(30) || CAST(doc_id AS VARCHAR)) AS k FROM documents ORDER BY k, doc_id LIMIT 100")
def w1_seeded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return clean.seeded_order(docs, 3, ["doc_id"], 100).withColumn("k", clean.seeded_key(3, "doc_id"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 40")
def w3_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").orderBy("doc_id").limit(40).select("doc_id", "lang")


# -- alignment --------------------------------------------------------------
ROWS_SQL = f"""{TASKS_SQL}, rows AS (
  SELECT id, v.variant, x, y FROM tasks CROSS JOIN (VALUES (0, 'original'), (1, 'paraphrase'), (2, 'idiomatic')) v(v, variant)
  WHERE v.v = 0 OR (row_idx + v.v) % 7 <> 0)"""


def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant rows of which some are missing."""
    each = harness.tasks(spark, sf_dir).select("id", "row_idx", "x", "y", F.posexplode(F.array(*map(F.lit, VARIANTS))).alias("v", "variant"))
    return each.filter((F.col("v") == 0) | ((F.col("row_idx") + F.col("v")) % 7 != 0)).select("id", "variant", "x", "y")


@query(f"WITH {ROWS_SQL}, ok AS (SELECT id FROM rows GROUP BY id HAVING count(DISTINCT variant) = 3) SELECT id, variant, y FROM rows WHERE id IN (SELECT id FROM ok)")
def j9_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.reconcile(variant_rows(spark, sf_dir), VARIANTS).select("id", "variant", "y")


@query(f"WITH {ROWS_SQL} SELECT id FROM rows GROUP BY id HAVING count(DISTINCT variant) = 3")
def t4_common_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.common_ids(variant_rows(spark, sf_dir), VARIANTS)


@query(f"""WITH {ROWS_SQL}, ok AS (SELECT id FROM rows GROUP BY id HAVING count(DISTINCT variant) = 3)
SELECT id, variant, 'unaligned' AS reason, 0 AS attempts FROM rows WHERE id NOT IN (SELECT id FROM ok) AND NOT (variant = 'original' AND CAST(id AS BIGINT) % 2 = 0)""")
def t5_unaligned_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = variant_rows(spark, sf_dir)
    known = rows.filter("variant = 'original' AND CAST(id AS BIGINT) % 2 = 0").select("id", "variant")
    return align.unaligned_skips(rows, known, VARIANTS).drop("failing")


@query(f"WITH {TASKS_SQL} SELECT id, y FROM tasks WHERE row_idx % 3 <> 0 AND row_idx % 5 <> 0")
def j6_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = harness.tasks(spark, sf_dir).select("id", "y", "row_idx")
    return align.remaining(rows, rows.filter("row_idx % 3 = 0"), rows.filter("row_idx % 5 = 0")).select("id", "y")


@query(f"WITH {TASKS_SQL} SELECT id, CASE WHEN row_idx % 4 = 0 THEN upper(lang) END AS cached, row_idx % 4 = 0 AS hit FROM tasks")
def j7_cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = harness.tasks(spark, sf_dir).select("id", "row_idx", "lang", F.lit("h").alias("prompt_hash"), F.lit("m").alias("augmenter_model"))
    cache = rows.filter("row_idx % 4 = 0").select("prompt_hash", "augmenter_model", "id", F.upper("lang").alias("response"))
    return align.with_cache(rows, cache.union(cache.withColumn("prompt_hash", F.lit("other")))).select("id", "cached", "hit")


@query(f"WITH {TASKS_SQL} SELECT count(*) FILTER (row_idx % 4 = 0) AS hits, count(*) FILTER (row_idx % 4 <> 0) AS misses FROM tasks")
def j7_cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.cache_stats(j7_cache_lookup(spark, sf_dir))


@query(f"WITH {TASKS_SQL} SELECT id, row_idx, CASE WHEN row_idx % 3 = 0 THEN 'new' ELSE 'old' END AS raw FROM tasks WHERE row_idx % 3 = 0 OR row_idx % 2 = 0")
def j8_merge_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = harness.tasks(spark, sf_dir).select("id", "row_idx")
    old, new = (rows.filter(f"row_idx % {k} = 0").select("id", F.lit(name).alias("raw")) for k, name in ((2, "old"), (3, "new")))
    return align.merge_resumed(rows, old, new)


@query(f"WITH {RAW_SQL}, p AS (SELECT id, variant, raw FROM outputs WHERE model_id = 'model-0' AND variant = 'original') SELECT t.id, t.y, p.raw FROM tasks t JOIN p ON t.id = p.id")
def j5_replay_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    prior = harness.outputs(spark, sf_dir).filter("model_id = 'model-0' AND variant = 'original'").select("id", "raw")
    return align.replayed(harness.tasks(spark, sf_dir).select("id", "y"), prior)


@query(f"WITH {TASKS_SQL} SELECT CAST(d.doc_id AS VARCHAR) AS id, coalesce(t.y, '') AS y FROM documents d LEFT JOIN tasks t ON CAST(d.doc_id AS VARCHAR) = t.id")
def j2_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"))
    return align.with_labels(docs, harness.tasks(spark, sf_dir).select("id", "y"))


@query("SELECT 'left' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'right', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def j12_same_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.same_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT DISTINCT lang FROM documents ORDER BY lang")
def t7_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang")


@query(f"""WITH {TASKS_SQL} SELECT id, 'Rewrite (label ' || y || '): ' || x || chr(10) || 'Gold label in words: ' || lang || chr(10) || chr(10) || 'Done {{x}}' AS prompt FROM tasks""")
def p11_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = harness.tasks(spark, sf_dir).withColumn("meta", F.to_json(F.struct(F.col("lang").alias("label_name"))))
    filled = rows.select("id", F.concat(augment.augment_prompt("Rewrite (label {y}): {x}\n{context}Done "), F.lit("{x}")).alias("prompt"))
    return filled

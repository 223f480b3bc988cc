"""The registered queries. Lexicons, order phrases, requests and score pairs are derived from the given tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import chunks as C
from ..operators import evaluation as E
from ..operators import pronounce as P
from ..operators import structure as T
from ..operators import timeline as U
from ..operators import tokens as K
from ..sources import corpus as S
from ..sources.shared import stored
from ..streaming import requests as R


#: Tasks a core at least: rules over text cost far more than dealing it, so that no task should hold a core's whole share.
TASKS = 4


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table, dealt anew where its files make fewer than TASKS tasks a core; large tables are left as they lie."""
    df = spark.read.parquet(f"{d}/{name}.parquet")
    tasks = TASKS * spark.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def docs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("doc_id", "text")


def sents(spark: SparkSession, d: str) -> DataFrame:
    return T.split_sentences(docs(spark, d))


def words(spark: SparkSession, d: str) -> DataFrame:
    return K.word_index(sents(spark, d))


def counted_words(spark: SparkSession, d: str) -> DataFrame:
    """(word, n) of all sentences by exact spelling. Texts are split into sentences only where that could change their words."""
    return K.word_totals(T.split_sentences(docs(spark, d), no_split=K.lettered(F.col("text"))))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """counted_words, written once, so that lexicons and types need no text again."""
    return stored(counted_words(spark, d), "words")


def lexicons(spark: SparkSession, d: str, counts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Gold: words of 50 or more uses; phones: of 10 to 49, a phone for each letter of the ASCII alphabet."""
    f = (counts if counts is not None else word_counts(spark, d)).groupBy(F.lower("word").alias("word")).agg(F.sum("n").alias("n"))
    gold = f.where("n >= 50").select("word", F.translate("word", "aeiou", "ɑɛɪoʊ").alias("ipa"))
    letter = lambda c: F.when(c.rlike("[aeiou]"), F.concat(F.upper(F.element_at(F.create_map(*[F.lit(x) for kv in {"a": "aa", "e": "eh", "i": "ih", "o": "ow", "u": "uw"}.items() for x in kv]), c)), F.lit("1"))).otherwise(F.upper(c))
    phones = f.where("n between 10 and 49 and word rlike '^[abdefgiklmnoprstuvwz]+$'").select("word", F.transform(F.split("word", ""), letter).alias("phones"))
    return gold, phones


def order_text(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    return o.select("o_orderkey", F.concat(F.lit("Order "), F.col("o_orderkey").cast("string"), F.lit(" of "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" cost $"), F.format_string("%d", F.floor("o_totalprice").cast("long"))).alias("text"))


def requests(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    ts = F.col("ts").cast("timestamp")
    return e.select(F.col("user_id").alias("session"), F.col("event_id").alias("request_id"), ts.alias("ts"), F.when(F.col("event_type") == "error", "flush").otherwise("request").alias("kind"), F.coalesce("value", F.lit(0.0)).alias("seconds"))


def pieces(spark: SparkSession, d: str) -> DataFrame:
    return sents(spark, d).select("doc_id", "sent_idx", F.lower("text").alias("phonemes"))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    """Lower-case ASCII letters and common punctuation; other symbols have no id."""
    return spark.range(128).select(F.char(F.col("id")).alias("symbol"), F.col("id").cast("int").alias("id")).where("symbol rlike '[a-z ,.]'")


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark texts against themselves without every fifth word."""
    w = F.split("text", r"\s+")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("ref"), F.array_join(F.filter(w, lambda x, i: (i + 1) % 5 != 0), " ").alias("hyp"))


def spoken(spark: SparkSession, d: str) -> DataFrame:
    gold, phones = lexicons(spark, d)
    return P.phonemize_corpus(sents(spark, d), gold, phones)


def types(spark: SparkSession, d: str) -> DataFrame:
    counts = word_counts(spark, d)
    return P.resolve_words(counts, *lexicons(spark, d, counts))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    counts = word_counts(spark, d)
    return K.lexicon_coverage(counts, *lexicons(spark, d, counts))


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    counts = word_counts(spark, d)
    return K.dictionary_filter(counts, lexicons(spark, d, counts)[0])


def emphatic(spark: SparkSession, d: str) -> DataFrame:
    counts = word_counts(spark, d)
    return K.emphasis_filter(counts, *lexicons(spark, d, counts))


def rule(name: str):
    """A rule over the text of orders and documents: what it makes of each, by hash and length."""
    fn = N.RULES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        every = order_text(spark, d).select(F.col("o_orderkey").alias("id"), "text").union(docs(spark, d))
        return every.select("id", fn(F.col("text")).alias("t")).select("id", F.char_length("t").alias("n"), F.md5("t").alias("md5"))

    return run


def verbalized(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("o_date"))
    return N.verbalize_columns(o, ["o_orderkey"], ["o_date"]).drop("o_date")


def normalized_orders(spark: SparkSession, d: str) -> DataFrame:
    return N.normalize_corpus(order_text(spark, d))


def normalized_sentences(spark: SparkSession, d: str) -> DataFrame:
    return N.normalize_with_lexicon(sents(spark, d).select("doc_id", "sent_idx", "text"), ["doc_id", "sent_idx"], "text", *lexicons(spark, d))


def samples(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("samples"))


def chunk_lengths(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("idx"), F.floor("o_totalprice").cast("long").alias("samples"), (F.col("o_totalprice") / 1e6).alias("elapsed"))


def durations(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "lineitem").select(F.col("l_orderkey").alias("utt_id"), F.col("l_linenumber").alias("tok_idx"), F.col("l_quantity").cast("int").alias("n_frames"))


def chapters(spark: SparkSession, d: str) -> DataFrame:
    return T.merge_short_chapters(T.split_chapters_raw(docs(spark, d)))


def chapter_rows(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "chapter_idx", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("md5"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("idx"), "text")


def selected(spark: SparkSession, d: str) -> DataFrame:
    ranges = read(spark, d, "benchmark").select((F.col("item_id") * 7).alias("lo"), (F.col("item_id") * 7 + 3).alias("hi"))
    return E.select_lines(lines(spark, d), ranges).select("idx")


def intervals(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d)
    done = r.where("kind = 'request'").withColumn("done_ts", F.timestamp_seconds(F.unix_micros("ts") / 1e6 + F.col("seconds") * 60))
    return R.drop_invalidated(done, r.where("kind = 'flush'")).select("session", "request_id")


def backlog(spark: SparkSession, d: str) -> DataFrame:
    r = requests(spark, d).where("kind = 'request'").select("session", "request_id", (F.unix_micros("ts") / 1e6).alias("at"), "seconds")
    return R.backlog_seconds(r).select("session", "request_id", F.round("backlog", 3).alias("backlog"), "warn")


def receipts(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").cast("timestamp").alias("ts"), F.coalesce("value", F.lit(0.0)).alias("seconds"))
    return R.process_receipts(e.withColumn("latency", F.col("seconds") / 2), "1 hour").select("source", "window_start", "n", F.round("audio_s", 4).alias("audio_s"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("turn"), F.col("turn").alias("seq"), F.concat(F.coalesce("text", F.lit("")), F.lit(" ")).alias("text"))
    return R.turn_sentences(c)


def resumed(spark: SparkSession, d: str) -> DataFrame:
    m = T.chapter_manifest(chapters(spark, d))
    return T.resume_pending(m, m.where("doc_id % 3 = 0")).select("doc_id", "chapter_idx", "output_name")



QUERIES = {
    "s02_ingest_stats": lambda s, d: S.corpus_ingest_stats(docs(s, d)),
    "s03_sentence_lines": lambda s, d: S.sentence_lines(sents(s, d)),
    "t01_paragraphs": lambda s, d: T.split_paragraphs(docs(s, d)).select("doc_id", "para_idx", F.md5("text").alias("md5")),
    "t02_headings": lambda s, d: T.classify_paragraphs(docs(s, d)).groupBy("kind").agg(F.count("*").alias("n")),
    "t03_chapters_raw": lambda s, d: chapter_rows(T.split_chapters_raw(docs(s, d))),
    "t04_chapters": lambda s, d: chapter_rows(chapters(s, d)),
    "t05_manifest": lambda s, d: T.chapter_manifest(chapters(s, d)),
    "t06_resume_pending": resumed,
    "t08_sentences": lambda s, d: sents(s, d).select("doc_id", "sent_idx", "text"),
    "t10_slice": lambda s, d: T.slice_chunks(sents(s, d), 2, 3).select("doc_id", "sent_idx", "text"),
    "t12_progress": lambda s, d: T.progress_eta(chunk_lengths(s, d).select("doc_id", F.col("idx").alias("chunk_idx"), F.col("idx").cast("string").alias("text"), "elapsed")).select("doc_id", "chunk_idx", "done", "total", F.round("eta", 3).alias("eta")),
    **{f"{k}_documents": rule(k) for k in N.RULES},
    "n20_normalize_orders": normalized_orders,
    "n20_normalize_documents": normalized_sentences,
    "n21_nsw_census": lambda s, d: N.nsw_census(read(s, d, "documents"), "lang", "source"),
    "n21_nsw_rollup": lambda s, d: N.nsw_rollup(read(s, d, "documents"), "lang", "source"),
    "n22_verbalize_orders": verbalized,
    "k01_tokens": lambda s, d: K.tokenize(sents(s, d)).groupBy("kind", "token").agg(F.count("*").alias("n")),
    "k02_words": lambda s, d: words(s, d).groupBy("doc_id").agg(F.count("*").alias("n_words"), F.max("word_idx").alias("last_idx")),
    "v01_dictionary": dictionary,
    "v02_emphasis": emphatic,
    "v03_coverage": coverage,
    "v03_frequencies": lambda s, d: K.word_frequencies(counted_words(s, d)),
    "p02_homographs": lambda s, d: P.homograph_senses(sents(s, d)),
    "p17_resolve_words": types,
    "p17_tiers": lambda s, d: types(s, d).groupBy("tier").agg(F.count("*").alias("types")),
    "p18_phonemize": spoken,
    "x04_letter_to_sound": lambda s, d: counted_words(s, d).select(F.lower("word").alias("word")).distinct().select("word", P.letter_to_sound(F.col("word")).alias("ipa")),
    "c01_cap": lambda s, d: C.enforce_cap(pieces(s, d), 60),
    "c02_chunk_stats": lambda s, d: C.chunk_stats(pieces(s, d), 60),
    "c03_ids": lambda s, d: C.phonemes_to_ids(pieces(s, d), vocab(s, d)).select("doc_id", "sent_idx", F.size("ids").alias("n_ids"), "dropped", F.aggregate("ids", F.lit(0).cast("long"), lambda a, x: a + x).alias("id_sum")),
    "c04_unmapped": lambda s, d: C.unmapped_symbols(pieces(s, d), vocab(s, d)),
    "c05_pad": lambda s, d: C.pad_and_check(C.phonemes_to_ids(pieces(s, d), vocab(s, d)), 200).groupBy("error").agg(F.count("*").alias("n"), F.sum(F.size("padded")).alias("padded")),
    "u01_u02_alignment": lambda s, d: U.expand_alignment(durations(s, d)).groupBy("utt_id").agg(F.count("*").alias("frames"), F.max("frame_idx").alias("last")),
    "u03_timeline": lambda s, d: U.utterance_timeline(chunk_lengths(s, d)),
    "u04_concat": lambda s, d: U.concat_with_silence(samples(s, d).select(F.floor(F.col("doc_id") / 4).alias("doc_id"), F.col("doc_id").alias("idx"), "samples"), 16).select("doc_id", F.size("samples").alias("n")),
    "u05_u10_prepare_samples": lambda s, d: U.prepare_samples(samples(s, d), 24_000, 16_000, 16).select("doc_id", "n_packets", "ms", F.size("pcm").alias("n")),
    "u11_realtime": lambda s, d: U.realtime_factor(chunk_lengths(s, d)).select("doc_id", F.round("audio_s", 6).alias("audio_s"), F.round("elapsed_s", 4).alias("elapsed_s")),
    "e03_wer": lambda s, d: E.wer(pairs(s, d), lexicons(s, d)),
    "e04_wer_plain": lambda s, d: E.wer_plain(pairs(s, d)).select("idx", "edits", "ref_words", F.round("wer", 6).alias("wer")),
    "e05_wer_summary": lambda s, d: E.wer_summary(E.wer(pairs(s, d), lexicons(s, d))),
    "e06_wer_macro": lambda s, d: E.wer_macro(E.wer_plain(pairs(s, d))),
    "e07_select_lines": selected,
    "e08_similarity": lambda s, d: pairs(s, d).select("idx", F.round(E.ipa_similarity(F.col("ref"), F.col("hyp")), 6).alias("score")),
    "e10_exact_match": lambda s, d: E.exact_match_summary(pairs(s, d).select("idx", F.col("ref").alias("expected"), F.col("hyp").alias("actual"))),
    "e11_deltas": lambda s, d: E.array_deltas(samples(s, d).select(F.col("doc_id").alias("idx"), F.col("samples").alias("a"), F.reverse("samples").alias("b"))).select("idx", F.round("max_abs", 5).alias("max_abs"), F.round("mean_abs", 5).alias("mean_abs")),
    "e12_mismatches": lambda s, d: E.mismatch_count(chunk_lengths(s, d), chunk_lengths(s, d).where("idx % 5 <> 0"), ["doc_id", "idx"], "samples"),
    "r01_turn_sentences": turns,
    "r02_generations": lambda s, d: R.assign_generation(requests(s, d)).select("session", "request_id", "generation"),
    "r03_drop_invalidated": intervals,
    "r04_flush_counts": lambda s, d: R.flush_counts(requests(s, d)),
    "r05_backlog": backlog,
    "r08_receipts": receipts,
}
FLAGSHIP = "p18_phonemize"

_SENTS = r"""
masked AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\n', ' ', 'g'), '(^|[^A-Za-z0-9])((?i:mrs|mr|ms|dr|prof|st|jr|sr|etc|vs|cf))\.', '\1\2' || chr(3), 'g'), '\.\.\.', repeat(chr(3), 3), 'g'), '([0-9])\.([0-9])', '\1' || chr(3) || '\2', 'g'), '([0-9])\.([0-9])', '\1' || chr(3) || '\2', 'g') AS t FROM documents),
raw AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(t, '([.!?;])', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(replace(x, chr(3), '.'), '^\s+|\s+$', '', 'g')), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) AS s FROM masked),
sents AS (SELECT doc_id, CAST(i - 1 AS INT) AS sent_idx, s[i] AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM raw))
"""
_WORDS = _SENTS + r""", toks AS (SELECT doc_id, sent_idx, regexp_extract_all(text, '[A-Za-z''’-]+|[,.!?;:“”—…]') AS ts FROM sents),
tok AS (SELECT doc_id, sent_idx, replace(unnest(ts), '’', '''') AS token FROM toks),
words AS (SELECT doc_id, token AS word FROM tok WHERE regexp_matches(token, '^[A-Za-z''-]')),
freq AS (SELECT lower(word) AS word, count(*) AS n FROM words GROUP BY 1),
gold AS (SELECT word FROM freq WHERE n >= 50), phones AS (SELECT word FROM freq WHERE n BETWEEN 10 AND 49 AND regexp_matches(word, '^[abdefgiklmnoprstuvwz]+$'))
"""
_CH = r"""
clean AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '^\s*\n', ''), '\n\s*$', '') AS t FROM documents),
ps AS (SELECT doc_id, string_split_regex(t, '\n\s*\n') AS p FROM clean WHERE regexp_matches(t, '\S')),
para AS (SELECT doc_id, CAST(i - 1 AS INT) AS para_idx, p[i] AS text FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM ps))
"""
_NUM = "[" + ", ".join(f"'{x}'" for x in "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()) + "]"
_TEN = "['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety']"
_ORD = "['first', 'second', 'third', 'fourth', 'fifth', 'sixth', 'seventh', 'eighth', 'ninth', 'tenth', 'eleventh', 'twelfth', 'thirteenth', 'fourteenth', 'fifteenth', 'sixteenth', 'seventeenth', 'eighteenth', 'nineteenth', 'twentieth', 'twenty first', 'twenty second', 'twenty third', 'twenty fourth', 'twenty fifth', 'twenty sixth', 'twenty seventh', 'twenty eighth', 'twenty ninth', 'thirtieth', 'thirty first']"
_PAIRS = r"pairs AS (SELECT item_id AS idx, text AS ref, array_to_string(list_filter(string_split_regex(text, '\s+'), lambda x, i: i % 5 <> 0), ' ') AS hyp FROM benchmark)"
_REQ = "req AS (SELECT user_id AS session, event_id AS request_id, ts, CASE WHEN event_type = 'error' THEN 'flush' ELSE 'request' END AS kind, coalesce(value, 0.0) AS seconds FROM events)"

ORACLES = {
    "s02_ingest_stats": "SELECT count(*) AS files, CAST(coalesce(sum(strlen(text)), 0) AS BIGINT) AS bytes, count(*) FILTER (WHERE coalesce(trim(text), '') = '') AS empty FROM documents",
    "s03_sentence_lines": f"WITH {_SENTS} SELECT trim(translate(text, chr(10) || chr(13), '  ')) AS value FROM sents",
    "t01_paragraphs": f"WITH {_CH} SELECT doc_id, para_idx, md5(text) AS md5 FROM para",
    "t08_sentences": f"WITH {_SENTS} SELECT doc_id, sent_idx, text FROM sents",
    "t10_slice": f"WITH {_SENTS} SELECT doc_id, sent_idx, text FROM sents WHERE sent_idx BETWEEN 2 AND 4",
    "t12_progress": "WITH x AS (SELECT o_custkey AS doc_id, o_orderkey AS chunk_idx, count(*) OVER r AS done, count(*) OVER (PARTITION BY o_custkey) AS total, avg(o_totalprice / 1e6::DOUBLE) OVER r AS a FROM orders WINDOW r AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING)) SELECT doc_id, chunk_idx, done, total, round(a * (total - done), 3) AS eta FROM x",
    "n21_nsw_census": r"SELECT lang, source, " + ", ".join(f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) AS n_{k}" for k, p in N.CENSUS.items()) + " FROM documents GROUP BY ALL",
    "n21_nsw_rollup": "SELECT lang, source, GROUPING(lang, source) AS level, count(*) AS docs, " + ", ".join(f"CAST(coalesce(sum(len(regexp_extract_all(text, '{p}'))), 0) AS BIGINT) AS n_{k}" for k, p in N.CENSUS.items()) + " FROM documents GROUP BY ROLLUP(lang, source)",
    "n22_verbalize_orders": f"""
WITH h AS (SELECT i, CASE WHEN i % 100 = 0 THEN '' WHEN i % 100 < 20 THEN {_NUM}[1 + i % 100] ELSE {_TEN}[i % 100 // 10 - 1] || CASE WHEN i % 10 > 0 THEN ' ' || {_NUM}[1 + i % 10] ELSE '' END END AS two FROM range(1000) t(i)),
w AS (SELECT i, trim(CASE WHEN i >= 100 THEN {_NUM}[1 + i // 100] || ' hundred ' ELSE '' END || two) AS s FROM h)
SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 'zero' ELSE trim(CASE WHEN o_orderkey >= 1000000 THEN (SELECT s FROM w WHERE i = o_orderkey // 1000000) || ' million ' ELSE '' END
  || CASE WHEN o_orderkey // 1000 % 1000 > 0 THEN (SELECT s FROM w WHERE i = o_orderkey // 1000 % 1000) || ' thousand ' ELSE '' END || (SELECT s FROM w WHERE i = o_orderkey % 1000)) END AS o_orderkey_words,
  monthname(o_orderdate) || ' ' || {_ORD}[day(o_orderdate)] || ' ' || CASE WHEN year(o_orderdate) = 2000 THEN 'two thousand' WHEN year(o_orderdate) BETWEEN 2001 AND 2009 THEN 'two thousand ' || {_NUM}[1 + year(o_orderdate) % 100]
    WHEN year(o_orderdate) % 100 = 0 THEN (SELECT s FROM w WHERE i = year(o_orderdate) // 100) || ' hundred' ELSE (SELECT s FROM w WHERE i = year(o_orderdate) // 100) || ' ' || (SELECT s FROM w WHERE i = year(o_orderdate) % 100) END AS o_date_words
FROM orders""",
    "k01_tokens": f"WITH {_WORDS} SELECT CASE WHEN regexp_matches(token, '^[A-Za-z''-]') THEN 'word' ELSE 'punct' END AS kind, token, count(*) AS n FROM tok GROUP BY ALL",
    "v01_dictionary": f"WITH {_WORDS} SELECT word FROM gold",
    "v02_emphasis": f"WITH {_WORDS} SELECT word FROM gold WHERE len(word) >= 3 UNION SELECT word FROM phones WHERE len(word) >= 6",
    "v03_coverage": f"WITH {_WORDS} SELECT CASE WHEN word IN (SELECT word FROM gold) THEN 'gold' WHEN word IN (SELECT word FROM phones) THEN 'phones' ELSE 'oov' END AS tier, count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens FROM freq GROUP BY 1",
    "v03_frequencies": f"WITH {_WORDS} SELECT word, n FROM freq",
    "c02_chunk_stats": f"WITH {_SENTS} SELECT count(*) AS chunks, CAST(sum(len(text)) AS BIGINT) AS symbols, count(*) FILTER (WHERE len(text) > 60) AS over_cap, count(*) FILTER (WHERE len(text) = 0) AS empty, max(len(text)) AS longest FROM sents",
    "c04_unmapped": f"WITH {_SENTS}, sym AS (SELECT unnest(string_split(lower(text), '')) AS symbol FROM sents) SELECT symbol, count(*) AS n FROM sym WHERE NOT regexp_matches(symbol, '^[a-z ,.]$') GROUP BY 1",
    "c03_ids": f"WITH {_SENTS}, sym AS (SELECT doc_id, sent_idx, unnest(string_split(lower(text), '')) AS c FROM sents) SELECT doc_id, sent_idx, CAST(count(*) FILTER (WHERE regexp_matches(c, '^[a-z ,.]$')) AS INT) AS n_ids, count(*) FILTER (WHERE NOT regexp_matches(c, '^[a-z ,.]$')) AS dropped, CAST(coalesce(sum(ascii(c)) FILTER (WHERE regexp_matches(c, '^[a-z ,.]$')), 0) AS BIGINT) AS id_sum FROM sym GROUP BY ALL",
    "u01_u02_alignment": "SELECT l_orderkey AS utt_id, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS frames, CAST(sum(CAST(l_quantity AS INT)) - 1 AS BIGINT) AS last FROM lineitem GROUP BY 1 HAVING sum(CAST(l_quantity AS INT)) > 0",
    "u03_timeline": "WITH x AS (SELECT o_custkey AS doc_id, o_orderkey AS idx, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 0 ELSE 1920 END AS INT) AS pad FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)), y AS (SELECT *, CAST(coalesce(sum(s + pad) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b FROM x) SELECT doc_id, idx, b AS start, b + s AS \"end\", pad FROM y",
    "u04_concat": "SELECT vec_id // 4 AS doc_id, CAST(sum(len(embedding)) + 16 * (count(*) - 1) AS INT) AS n FROM embeddings GROUP BY 1",
    "u05_u10_prepare_samples": "WITH m AS (SELECT vec_id, CAST(round(len(embedding) * 16000 / 24000.0) AS INT) AS n FROM embeddings) SELECT vec_id AS doc_id, CAST(ceil(n / 16.0) AS INT) AS n_packets, CAST(n * 1000 // 16000 AS BIGINT) AS ms, n FROM m",
    "u11_realtime": "SELECT o_custkey AS doc_id, round(sum(CAST(floor(o_totalprice) AS BIGINT)) / 24000.0::DOUBLE, 6) AS audio_s, round(sum(o_totalprice / 1e6::DOUBLE), 4) AS elapsed_s FROM orders GROUP BY 1",
    "e07_select_lines": "SELECT doc_id AS idx FROM documents d WHERE EXISTS (SELECT 1 FROM benchmark b WHERE d.doc_id BETWEEN b.item_id * 7 AND b.item_id * 7 + 3)",
    "e08_similarity": rf"WITH {_PAIRS}, x AS (SELECT idx, regexp_replace(ref, '[\s_ː]', '', 'g') AS a, regexp_replace(hyp, '[\s_ː]', '', 'g') AS b FROM pairs) SELECT idx, round(CASE WHEN greatest(len(a), len(b)) = 0 THEN 1.0 ELSE greatest(0.0, 1 - (len(a) - len(b)) / greatest(len(a), len(b))::DOUBLE) END, 6) AS score FROM x",
    "e10_exact_match": f"WITH {_PAIRS} SELECT count(*) AS total, count(*) FILTER (WHERE ref = hyp) AS exact, avg(CAST(ref = hyp AS DOUBLE)) AS accuracy, min(idx) FILTER (WHERE ref <> hyp) AS first_mismatch, avg(CAST(ref = hyp AS DOUBLE)) >= 1.0 AS passed FROM pairs",
    "e11_deltas": "WITH x AS (SELECT vec_id AS idx, list_transform(range(1, len(embedding) + 1), lambda i: abs(embedding[i]::DOUBLE - embedding[len(embedding) + 1 - i]::DOUBLE)) AS d FROM embeddings) SELECT idx, round(list_max(d), 5) AS max_abs, round(list_sum(d) / len(d), 5) AS mean_abs FROM x",
    "e12_mismatches": "SELECT count(*) AS places, count(*) FILTER (WHERE o_orderkey % 5 = 0) AS mismatches FROM orders",
    "r02_generations": f"WITH {_REQ} SELECT session, request_id, CAST(coalesce(sum(CAST(kind = 'flush' AS INT)) OVER (PARTITION BY session ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS generation FROM req",
    "r03_drop_invalidated": f"WITH {_REQ} SELECT session, request_id FROM req r WHERE kind = 'request' AND NOT EXISTS (SELECT 1 FROM req f WHERE f.kind = 'flush' AND f.session = r.session AND f.ts >= r.ts AND epoch_us(f.ts) < epoch_us(r.ts) + r.seconds * 60000000)",
    "r04_flush_counts": f"WITH {_REQ}, g AS (SELECT session, kind, coalesce(sum(CAST(kind = 'flush' AS INT)) OVER (PARTITION BY session ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS generation FROM req) SELECT session, CAST(generation AS BIGINT) AS generation, count(*) AS drained FROM g WHERE kind = 'request' GROUP BY ALL",
    "r08_receipts": "SELECT event_type AS source, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS n, round(sum(coalesce(value, 0.0)), 4) AS audio_s FROM events GROUP BY ALL",
}

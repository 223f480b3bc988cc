"""Document structure: paragraphs, headings, chapters, sentences. Documents are rows (doc_id, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind, where_found

# Fixed values.
HEADINGS = "chapter part book section prologue epilogue interlude preface foreword afterword introduction".split()
STOPWORDS = "a an and as at but by for from in into of on or the to with via vs".split()
ABBREVIATIONS = "mrs. mr. ms. dr. prof. st. jr. sr. e.g. i.e. etc. vs. cf. a.m. p.m.".split()
SHORT_CHAPTER_BYTES = 2000

_BLANK = r"\n\s*\n"


def _clean(text: Column) -> Column:
    """Line ends made \\n, blank lines at either end removed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"^\s*\n", ""), r"\n\s*$", "")


def split_paragraphs(docs: DataFrame) -> DataFrame:
    """(doc_id, para_idx, text, gap): runs of non-blank lines, and the blank lines after each."""
    clean = docs.select("doc_id", _clean(F.col("text")).alias("t")).where(F.col("t").rlike(r"\S"))
    zipped = F.zip_with(F.split("t", _BLANK, -1), F.regexp_extract_all("t", F.lit(_BLANK), F.lit(0)), lambda p, g: F.struct(p.alias("p"), F.coalesce(g, F.lit("")).alias("g")))
    return clean.select("doc_id", F.posexplode(zipped).alias("para_idx", "z")).select("doc_id", "para_idx", F.col("z.p").alias("text"), F.col("z.g").alias("gap"))


def is_heading(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    letters = F.regexp_replace(t, r"[^\p{L}]", "")
    content = F.filter(F.split(t, r"\s+"), lambda w: w.rlike(r"\p{L}") & ~F.lower(F.regexp_replace(w, r"^[^\p{L}]+|[^\p{L}]+$", "")).isin(STOPWORDS))
    titled = (F.size(F.split(t, r"\s+")) >= 2) & (F.size(content) >= 1) & F.forall(content, lambda w: F.regexp_extract(w, r"\p{L}", 0).rlike(r"\p{Lu}"))
    shape = (
        F.lower(t).rlike(rf"^(?:{'|'.join(HEADINGS)})(?:[^\p{{L}}]|$)")
        | t.rlike("^[0-9]{1,4}$")
        | t.rlike("^[IVXLCDM]{1,8}$")
        | (F.char_length(F.regexp_replace(letters, r"[^\p{Lu}]", "")) * 2 > F.char_length(letters))
        | titled
    )
    return (F.char_length(t) <= 60) & ~t.rlike(r"[.!?]$") & t.rlike(r"[\p{L}\p{N}]") & ~t.rlike("^[—–]") & shape


def classify_paragraphs(docs: DataFrame) -> DataFrame:
    """split_paragraphs with kind: heading or body."""
    return split_paragraphs(docs).withColumn("kind", F.when(is_heading(F.col("text")), "heading").otherwise("body"))


def split_chapters_raw(docs: DataFrame) -> DataFrame:
    """(doc_id, chapter_idx, text): a chapter starts where a heading follows body text."""
    line = Window.partitionBy("doc_id").orderBy("para_idx")
    starts = ((F.lag("kind").over(line) == "body") & (F.col("kind") == "heading")).cast("int")
    numbered = classify_paragraphs(docs).withColumn("chapter_idx", F.sum(F.coalesce(starts, F.lit(0))).over(line.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    parts = numbered.groupBy("doc_id", "chapter_idx").agg(F.array_sort(F.collect_list(F.struct("para_idx", "text", "gap"))).alias("ps"))
    joined = F.array_join(F.transform("ps", lambda p, i: F.concat(p["text"], F.when(i < F.size("ps") - 1, p["gap"]).otherwise(F.lit("")))), "")
    return parts.select("doc_id", "chapter_idx", joined.alias("text"))


def merge_short_chapters(chapters: DataFrame, min_bytes: int = SHORT_CHAPTER_BYTES) -> DataFrame:
    """(doc_id, chapter_idx, text, n_bytes): runs of short chapters become one, joined by a blank line."""
    line = Window.partitionBy("doc_id").orderBy("chapter_idx")
    short = F.octet_length("text") < min_bytes
    new = ~(short & F.coalesce(F.lag(short).over(line), F.lit(False)))
    runs = chapters.withColumn("run", F.sum(new.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("doc_id", "run").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", "text"))).alias("cs"))
    return merged.select("doc_id", (F.col("run") - 1).cast("int").alias("chapter_idx"), F.array_join(F.transform("cs", lambda c: c["text"]), "\n\n").alias("text")).withColumn("n_bytes", F.octet_length("text"))


def chapter_manifest(chapters: DataFrame, ext: str = "wav") -> DataFrame:
    """(doc_id, chapter_idx, total, output_name, preview)."""
    total = F.count("*").over(Window.partitionBy("doc_id")).cast("int")
    width = lambda: F.greatest(F.lit(3), F.length(F.col("total").cast("string")))
    preview = F.substring(F.get(F.filter(F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != ""), F.lit(0)), 1, 72)
    named = chapters.withColumn("total", total)
    number = (F.col("chapter_idx") + 1).cast("string")
    return named.select("doc_id", "chapter_idx", "total", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit("_"), F.lpad(number, width(), F.lit("0")), F.lit(f".{ext}")).alias("output_name"), preview.alias("preview"))


def resume_pending(manifest: DataFrame, done: DataFrame) -> DataFrame:
    """Chapters whose output does not exist yet."""
    return manifest.join(done.select("doc_id", "chapter_idx"), ["doc_id", "chapter_idx"], "left_anti")


def quarantine_failures(attempted: DataFrame, error: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ok, failed, summary): rows with an error set aside, the rest going on."""
    marked = attempted.withColumn("error", error)
    status = F.when(F.col("error").isNull(), "rendered").otherwise("failed")
    return marked.where("error is null").drop("error"), marked.where("error is not null"), marked.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


_END, _PAUSE, _DOT = "\u0001", "\u0002", "\u0003"
_ONE_DOT = "|".join(a[:-1] for a in ABBREVIATIONS if a.count(".") == 1)
_TWO_DOTS = [a for a in ABBREVIATIONS if a.count(".") == 2]


def _stripped(s: Column) -> Column:
    """Without blanks at either end; $ also stands before a last line separator, which trim() does not know."""
    return F.when(s.rlike("[\u0085\u2028\u2029]"), F.regexp_replace(s, r"^\s+|\s+$", "")).otherwise(F.trim(s, F.lit(" \t\n\x0b\f\r")))


def sentence_pieces(text: Column, no_split: bool | Column = False) -> Column:
    """Array of sentences; an empty string is an explicit pause. Texts for which no_split holds stay whole."""
    t = where_found(text, f"[{_END}{_PAUSE}{_DOT}]", lambda x: F.translate(x, _END + _PAUSE + _DOT, ""))
    whole = F.array(F.trim(t))
    if isinstance(no_split, Column):
        return F.when(no_split, whole).otherwise(_sentences(t))
    return whole if no_split else _sentences(t)


def _sentences(t: Column) -> Column:
    t = F.regexp_replace(t, r"(?<!\n)\n(?!\n)", " ")
    t = F.regexp_replace(t, r"(?<!\n)\n\n", _END)
    # of longer runs of line ends, each further one is a pause, a piece of its own
    t = F.replace(t, F.lit("\n"), F.lit(_PAUSE + _END))
    # a pattern begins with the dot, for which Java looks fast, and then looks back
    t = F.regexp_replace(t, rf"\.(?<=(?<![A-Za-z0-9])(?i:{_ONE_DOT})\.)", _DOT)

    def two_dots(x: Column) -> Column:
        for a in _TWO_DOTS:
            x = F.regexp_replace(x, rf"(?<![A-Za-z0-9])(?i:({a[0]})\.({a[2]})\.)", f"$1{_DOT}$2{_DOT}")
        return x

    t = where_found(t, rf"\.[{''.join(a[2] + a[2].upper() for a in _TWO_DOTS)}]\.", two_dots)
    t = F.replace(t, F.lit("..."), F.lit(_DOT * 3))
    t = F.regexp_replace(t, r"\.(?<=[0-9]\.)(?=[0-9])", _DOT)
    t = F.regexp_replace(t, r"([.!?;])", f"$1{_END}")
    return bind(F.replace(t, F.lit(_DOT), F.lit(".")), _pieces)


def _pieces(t: Column) -> Column:
    """A marked text cut at its ends. What only few texts need, blanks other than spaces and pauses, is asked of the text, not of every piece."""
    cut = F.split(t, _END)
    stripped = F.when(t.rlike("[\t\x0b\f\r\u0085\u2028\u2029]"), F.transform(cut, _stripped)).otherwise(F.transform(cut, lambda s: F.trim(s)))
    said = lambda s: s.rlike(r"[\p{L}\p{N}]")
    paused = F.transform(F.filter(stripped, lambda s: said(s) | (s == _PAUSE)), lambda s: F.when(s == _PAUSE, "").otherwise(s))
    return F.when(t.contains(_PAUSE), paused).otherwise(F.filter(stripped, said))


def split_sentences(docs: DataFrame, no_split: bool | Column = False) -> DataFrame:
    """(doc_id, sent_idx, text, is_pause)."""
    return docs.select("doc_id", F.posexplode(sentence_pieces(F.col("text"), no_split)).alias("sent_idx", "text")).withColumn("is_pause", F.col("text") == "")


def slice_chunks(sentences: DataFrame, skip: int, n: int) -> DataFrame:
    """A window of each document's sentences, taken before anything heavy."""
    return sentences.where(F.col("sent_idx").between(skip, skip + n - 1))


def progress_eta(chunks: DataFrame) -> DataFrame:
    """(doc_id, chunk_idx, done, total, percent, eta, snippet) from (doc_id, chunk_idx, text, elapsed)."""
    by = Window.partitionBy("doc_id")
    run = by.orderBy("chunk_idx").rowsBetween(Window.unboundedPreceding, 0)
    done, total = F.count("*").over(run), F.count("*").over(by)
    snippet = F.when(F.char_length("text") > 60, F.concat(F.substring("text", 1, 60), F.lit("…"))).otherwise(F.col("text"))
    return chunks.select("doc_id", "chunk_idx", done.alias("done"), total.alias("total"), (100.0 * done / total).alias("percent"), (F.avg("elapsed").over(run) * (total - done)).alias("eta"), snippet.alias("snippet"))

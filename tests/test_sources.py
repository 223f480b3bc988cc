"""Sources and sinks on small files."""

import json

import pytest
from pyspark.sql import functions as F

from voicegrist.operators import pronounce as P
from voicegrist.sources import corpus as S


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_text_corpus(spark, tmp_path):
    put(tmp_path / "a" / "one.txt", "One.\nTwo.")
    put(tmp_path / "b" / "two.txt", " ")
    put(tmp_path / "b" / "none.txt", "")
    put(tmp_path / "b" / "other.md", "no")
    docs = S.read_text_corpus(spark, str(tmp_path))
    assert sorted(r.text for r in docs.collect()) == [" ", "One.\nTwo."] and S.read_text_corpus(spark, str(tmp_path), 1).count() == 1
    assert tuple(S.corpus_ingest_stats(docs).first()) == (2, 10, 1)


def test_lexicons(spark, tmp_path):
    phones = S.read_phone_lexicon(spark, put(tmp_path / "p.txt", ";;; note\nREAD  R EH1 D\nREAD(2)  R IY1 D\ncat  K AE1 T\nCAT  K AA1 T\n"))
    assert {r.word: r.phones for r in phones.collect()} == {"read": ["R", "EH1", "D"], "cat": ["K", "AE1", "T"]}
    gold = S.read_gold_lexicon(spark, put(tmp_path / "g.json", json.dumps({"Paris": "pˈɛɹɪs", "lead": {"DEFAULT": "lˈid", "NOUN": "lˈɛd"}, "odd": {"VERB": "v", "ADJ": "a"}, "US": "jˌuˈɛs", "us": "ˌʌs"})))
    assert {r.word: r.ipa for r in gold.collect()} == {"Paris": "pˈɛɹɪs", "paris": "pˈɛɹɪs", "lead": "lˈid", "odd": "a", "US": "jˌuˈɛs", "us": "ˌʌs"}
    said = {r.word: (r.ipa, r.tier) for r in P.resolve_words(spark.createDataFrame([("cat",), ("lead",)], "word string"), gold, phones).collect()}
    assert said == {"cat": ("kˈæt", "phones"), "lead": ("lˈid", "gold")}


def test_overrides(spark, tmp_path):
    rules, own = S.read_overrides(spark, put(tmp_path / "o.json", json.dumps({"rewrites": [{"pattern": "(?i)sql", "replacement": "sequel"}], "pronunciations": {"Foo": "fˈu"}})))
    assert rules == [("(?i)sql", "sequel")] and [tuple(r) for r in own.collect()] == [("foo", "fˈu")]
    from voicegrist.functions import normalize as N

    assert N.normalize_corpus(spark.createDataFrame([("my SQL.",)], "text string"), rewrites=rules).first().text == "my sequel."
    empty = spark.createDataFrame([], "word string, ipa string")
    got = P.resolve_words(spark.createDataFrame([("FOO",), ("foo",)], "word string"), empty, spark.createDataFrame([], "word string, phones array<string>"), own).collect()
    assert {tuple(r) for r in got} == {("FOO", "fˈu", "override"), ("foo", "fˈu", "override")}
    with pytest.raises(Exception):
        S.read_overrides(spark, put(tmp_path / "bad.json", json.dumps({"rewrites": [{"pattern": "(", "replacement": ""}], "pronunciations": {}})))


def test_lines_cases_and_symbols(spark, tmp_path):
    lines = S.read_numbered_lines(spark, put(tmp_path / "l.txt", "a\r\n\nb\n"))
    assert [(r.idx, r.text) for r in lines.orderBy("idx").collect()] == [(0, "a"), (1, ""), (2, "b")]
    assert [tuple(r) for r in S.read_eval_cases(spark, put(tmp_path / "c.tsv", '5 km\t"five kilometers"\n')).collect()] == [("5 km", '"five kilometers"')]
    assert [tuple(r) for r in S.read_eval_cases(spark, put(tmp_path / "c.jsonl", '{"case": "a", "ipa": "b"}\n'), "jsonl").collect()] == [("a", "b")]
    assert {tuple(r) for r in S.read_symbol_vocab(spark, put(tmp_path / "v.json", '{"vocab": {"a": 1, "ˈ": 2}}')).collect()} == {("a", 1), ("ˈ", 2)}


def test_sinks(spark, tmp_path):
    sents = spark.createDataFrame([("One\ntwo. ",), (" ",)], "text string")
    S.write_sentence_lines(sents, str(tmp_path / "s"))
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ["One two."]
    S.write_chapter_dataset(spark.createDataFrame([(7, 0, "x"), (7, 1, "y")], "doc_id long, chapter_idx int, text string"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c")).where("doc_id = 7").count() == 2


def test_ingest_report(spark, tmp_path):
    import gzip

    from voicegrist.operators import structure as T

    put(tmp_path / "a" / "good.txt", "One. Two.\nThree.")
    put(tmp_path / "a" / "none.txt", "")
    put(tmp_path / "b" / "blank.txt", " \n\t ")
    (tmp_path / "b" / "latin.txt").write_bytes(b"caf\xe9.")
    whole = gzip.compress(b"Four. Five. " * 500)
    (tmp_path / "b" / "whole.txt.gz").write_bytes(whole)
    (tmp_path / "b" / "cut.txt.gz").write_bytes(whole[: len(whole) // 2])
    put(tmp_path / "b" / "other.md", "no")
    report = S.ingest_report(spark, str(tmp_path), T.sentence_pieces)
    assert {r.path.rsplit("/", 1)[1]: (r.status, r.sentences) for r in report.collect()} == {"good.txt": ("read", 3), "none.txt": ("empty", None), "blank.txt": ("empty", None), "latin.txt": ("error", None), "whole.txt.gz": ("read", 1000), "cut.txt.gz": ("error", None)}
    assert tuple(S.ingest_totals(report).first())[0] == 6 and tuple(S.ingest_totals(report).first())[3:] == (2, 2)


def test_named_outputs_and_resume(spark, tmp_path):
    from voicegrist.operators import structure as T

    chapters = spark.createDataFrame([(7, 0, "first\npart"), (7, 1, "second"), (8, 0, "other")], "doc_id long, chapter_idx int, text string")
    manifest = T.chapter_manifest(chapters, "txt")
    out, asked = str(tmp_path / "out"), []

    def render(rows):
        asked.append(sorted(r.output_name for r in rows.collect()))
        return rows.select("output_name", F.upper("preview").alias("text"))

    put(tmp_path / "out" / "output_name=doc8_001.txt" / "muted", "")
    assert sorted(r.output_name for r in S.render_pending(manifest, out, render).collect()) == ["doc7_001.txt", "doc7_002.txt"]
    assert sorted(r.output_name for r in S.existing_outputs(spark, out).collect()) == ["doc7_001.txt", "doc7_002.txt", "doc8_001.txt"]
    assert S.render_pending(manifest, out, render).count() == 0 and asked == [["doc7_001.txt", "doc7_002.txt"], []]
    assert spark.read.text(f"{out}/output_name=doc7_002.txt").first().value == "SECOND"
    assert len([p for p in (tmp_path / "out" / "output_name=doc7_001.txt").iterdir() if p.name.startswith("part-")]) == 1
    assert S.existing_outputs(spark, str(tmp_path / "nowhere")).count() == 0

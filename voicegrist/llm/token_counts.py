"""Token counts: lengths only, from Arrow batches balanced by bytes.

A text is cut at every safe boundary: an ASCII blank before an ASCII letter or digit. The
tokenizer drops blanks and never joins across them, so the counts of the pieces add up to the
count of the text. Equal pieces are encoded once: a bounded table keeps their counts. Pieces
not yet known go to the library in one batch of bounded bytes.

Defined results: null or empty text has 0 bytes and 0 tokens; repeated rows are counted alike;
a piece without a safe boundary (one huge word) is encoded whole; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table

_SAFE = re.compile(r"[ \t\n\r]+(?=[A-Za-z0-9])")


class PieceCounts(dict):
    """piece -> tokens; forgets all when it gets large, and never keeps long pieces."""

    LIMIT, LONGEST, BATCH_BYTES = 1 << 18, 80, 1 << 20

    def __init__(self, encode_lengths: Callable[[list[str]], list[int]]):
        super().__init__()
        self.encode_lengths = encode_lengths

    def learn(self, pieces: Iterable[str]) -> dict[str, int]:
        """Counts of pieces not yet known, in batches of about BATCH_BYTES characters."""
        once: dict[str, int] = {}
        batch: list[str] = []
        held = 0
        for p in pieces:
            batch.append(p)
            held += len(p)
            if held >= self.BATCH_BYTES:
                once.update(zip(batch, self.encode_lengths(batch), strict=True))
                batch, held = [], 0
        if batch:
            once.update(zip(batch, self.encode_lengths(batch), strict=True))
        self.update((p, n) for p, n in once.items() if len(p) <= self.LONGEST)
        return once

    def count(self, text: str) -> int:
        if len(self) > self.LIMIT:  # before any piece of this text is looked up
            self.clear()
        pieces = _SAFE.split(text)
        new = {p for p in pieces if p not in self}
        once = self.learn(new) if new else {}
        known = self.get
        return sum(once[p] if (n := known(p)) is None else n for p in pieces)


def json_encoder(path: str) -> Callable[[list[str]], list[int]]:
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return lambda texts: [len(e) for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs(doc_id, text)."""

    def lengths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        counts = PieceCounts(json_encoder(public_tokenizers.path(vocabulary)))
        for b in batches:
            texts = b.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([counts.count(t) if t else 0 for t in texts], pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    # octet_length is done by the JVM, as is the comparison
    lens = map_arrow(docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), lengths, "doc_id long, n_bytes long, n_tokens long")
    return lens.withColumn("over_limit", F.col("n_tokens") > limit)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


QUERIES = {"op5_token_counts": op5_token_counts}
ORACLES: dict[str, str] = {}

"""Language identification by cross-parsing entropy.

Learning: for each language, however many there are, a suffix automaton is built over labelled text: pieces of
PIECE_BYTES from all places of its texts, those of least hash, SAMPLE_BYTES in all (a documented bound on labelled
text). Text is folded to UTF-8 of lower-case letters and their marks, any other run being one blank; the automaton
reads bytes, so its table stays small in every script.

Prediction: a whole text is parsed against each automaton into phrases: from a place, the longest match that
occurs in the labelled text of the language, then on from its end; a byte that never occurs there is a phrase of its
own. Matches run across words. The phrases of a language cost log2 of its labelled bytes each, for a phrase points
into them; this sum over the bytes of the text is the cross entropy, and the language of the least wins. The score
is the winner's weight among all languages, a language weighing 2 ** -(bits beyond those of the winner).

The texts of a batch are parsed side by side: a table gives for each state and byte the next state and the phrases
that end, so a step is one lookup for all texts and languages. A task holds the automata of BLOCK languages; with
more languages there are more passes, and the bits of a text in all of them are brought together.

Defined results: null texts and those without a letter (marks, digits and number signs are none) are ``und`` with
score 0; ties go to the language that sorts first; with no labelled row at all every text is ``und``; repeated rows
are treated alike; very long texts are parsed whole; a learned text without a letter teaches nothing; columns but
doc_id, text and the label are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, row_key, stored, table

#: Languages of a pass; pieces of a language, bytes of a piece and of a language; bytes of text parsed side by side.
BLOCK, PIECES, PIECE_BYTES, SAMPLE_BYTES = 6, 60, 2_000, 60_000
LANES_BYTES = 24 << 20
#: With at most so many chosen texts their keys are broadcast.
MOST_PIECES = 100_000


def folded(text: Column) -> Column:
    """Letters and marks, lower-cased, all else one blank; null for texts without a letter."""
    return F.when(text.rlike(r"\p{L}"), F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}]+", " ")), F.lit(" ")))


class SuffixAutomaton:
    """All substrings of some texts, as a table of states by symbols; no match runs across two texts."""

    def __init__(self, texts: list[bytes], symbols: np.ndarray, width: int):
        size = sum(map(len, texts))
        steps = array("i", bytes(4 * width * (2 * size + 2)))  # 0: no step
        link, length = array("i", [0]) * (2 * size + 2), array("i", [0]) * (2 * size + 2)
        link[0], states = -1, 1
        for text in texts:
            last = 0
            for c in symbols[np.frombuffer(text, np.uint8)].tolist():
                q = steps[last * width + c]
                if q and length[q] == length[last] + 1:  # known from a text before
                    last = q
                    continue
                cur, p = states, last
                states += 1
                length[cur] = length[last] + 1
                while p >= 0 and not steps[p * width + c]:
                    steps[p * width + c] = cur
                    p = link[p]
                if p < 0:
                    link[cur] = 0
                else:
                    q = steps[p * width + c]
                    if length[p] + 1 == length[q]:
                        link[cur] = q
                    else:
                        clone = states
                        states += 1
                        length[clone] = length[p] + 1
                        steps[clone * width : (clone + 1) * width] = steps[q * width : (q + 1) * width]
                        link[clone] = link[q]
                        link[q] = link[cur] = clone
                        while p >= 0 and steps[p * width + c] == q:
                            steps[p * width + c] = clone
                            p = link[p]
                        if length[cur] == length[clone]:  # the same strings: cur is not needed
                            cur, states = clone, states
                last = cur
        self.steps = np.frombuffer(steps, np.int32)[: states * width].reshape(states, width)


class CrossParser:
    """Bits of texts in several languages."""

    def __init__(self, samples: dict[str, list[bytes]]):
        self.languages = sorted(samples)
        used = np.unique(np.frombuffer(b"".join(t for x in self.languages for t in samples[x]), np.uint8))
        self.symbols = np.zeros(256, np.int64)  # 0: a byte of no language
        self.symbols[used] = np.arange(1, len(used) + 1)
        self.width = len(used) + 1
        tables, self.roots, at = [], [], 0
        for x in self.languages:
            t = SuffixAutomaton(samples[x], self.symbols, self.width).steps.astype(np.int64)
            root = np.broadcast_to(t[0], t.shape)
            to = np.where(t == 0, root, t)
            # a phrase ends where no step goes on, and a byte unknown to the language is a phrase
            ended = ((t == 0) & (np.arange(len(t)) > 0)[:, None]).astype(np.int64) + (to == 0)
            tables.append(((to + at) * self.width * 4 + ended).astype(np.int32).ravel())
            self.roots.append(at * self.width)
            at += len(t)
        self.steps = np.concatenate(tables) if tables else np.empty(0, np.int32)
        self.bits = np.array([np.log2(max(2, sum(map(len, samples[x])))) for x in self.languages])

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """[texts, languages] phrases of the greedy parses."""
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")
        symbols = self.symbols[np.frombuffer(b"".join(texts), np.uint8)].astype(np.int16)
        at = (np.cumsum(sizes) - sizes)[order]
        alive = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), side="left")  # texts longer than each place
        roots = np.array(self.roots)
        state = np.tile(roots, (len(texts), 1))
        count = np.zeros(state.shape, np.int32)
        for place, n in enumerate(alive.tolist()):
            v = self.steps[state[:n] + symbols[at[:n] + place][:, None]]
            count[:n] += v & 3
            state[:n] = v >> 2
        count += state != roots
        out = np.empty_like(count)
        out[order] = count
        return out

    def costs(self, texts: list[bytes]) -> np.ndarray:
        """[texts, languages] bits."""
        return self.phrases(texts) * self.bits


def sample_blocks(labelled: DataFrame, label: str = "lang") -> Iterator[dict[str, list[bytes]]]:
    """A bounded sample for each label, BLOCK labels at a time: pieces of least hash from all places of its texts."""
    texts = labelled.where(F.col(label).isNotNull()).select(F.col(label).alias("name"), row_key().alias("ht"), "text")
    # a text is cut into pieces of equal length, each with its own hash
    n = F.ceil(F.octet_length("text") / PIECE_BYTES).cast("int")
    sized = texts.where(F.octet_length("text") > 0).select("name", "ht", n.alias("n"))
    pieces = sized.select("name", "ht", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")).withColumn("h", F.xxhash64("ht", "i"))
    # the pieces of least hash of each label, without bringing a label's rows together: min keeps PIECES slots
    least = pieces.groupBy("name", F.pmod("h", F.lit(PIECES)).alias("slot")).agg(F.min(F.struct("h", "ht", "i")).alias("p"))
    chosen = least.groupBy("name", F.col("p.ht").alias("ht")).agg(F.collect_list(F.struct("slot", "p.i")).alias("at"))
    chosen = stored(chosen, "language-pieces")
    if chosen.count() <= MOST_PIECES:
        chosen = F.broadcast(chosen)  # so texts stay where they are
    step = F.ceil(F.char_length("text") / n).cast("int")
    held = texts.join(chosen, ["name", "ht"]).select("name", F.explode(F.transform("at", lambda x: F.struct(x["slot"].alias("slot"), F.substring(F.col("text"), x["i"] * step + 1, step).alias("t")))).alias("x"))
    slots = stored(held.groupBy("name", F.col("x.slot").alias("slot")).agg(F.min("x.t").alias("t")).select("name", "slot", folded(F.col("t")).alias("t")), "language-samples")
    names = sorted(r[0] for r in slots.select("name").distinct().collect())
    for i in range(0, len(names), BLOCK):
        out: dict[str, list[bytes]] = {x: [] for x in names[i : i + BLOCK]}
        room = dict.fromkeys(out, SAMPLE_BYTES)
        block = slots.where(F.col("name").isin(list(out)) & F.col("t").isNotNull()).collect()  # at most BLOCK * PIECES pieces
        for r in sorted(block, key=lambda r: (r["name"], r["slot"])):
            t = r["t"].encode()[: room[r["name"]]]
            out[r["name"]].append(t)
            room[r["name"]] -= len(t)
        yield {x: [t for t in ts if t] for x, ts in out.items() if any(ts)}


def _decided(costs: np.ndarray, languages: list[str]) -> tuple[list[str], np.ndarray]:
    best = costs.argmin(axis=1)
    with np.errstate(under="ignore"):
        weights = 2.0 ** -(costs - costs.min(axis=1, keepdims=True))
    return [languages[i] for i in best], 1 / weights.sum(axis=1)


def _in_lanes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to LANES_BYTES of the text in their last column."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.column(b.num_columns - 1).nbytes
        if size >= LANES_BYTES:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def _texts(t: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    """Which rows have a text, and these texts, in a table whose last column they are."""
    whole = t.column(t.num_columns - 1).cast(pa.large_binary()).to_pylist()
    return np.array([x is not None for x in whole], bool), [x for x in whole if x is not None]


def identify(docs: DataFrame, blocks: Iterable[dict[str, list[bytes]]]) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs(doc_id, text)."""
    blocks = [x for x in blocks if x]
    shared = [docs.sparkSession.sparkContext.broadcast(x) for x in blocks or [{}]]
    if len(shared) > 1:
        return _over_blocks(docs, shared)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = CrossParser(shared[0].value)
        for t in _in_lanes(batches):
            has, texts = _texts(t)
            lang, score = np.full(len(has), "und", object), np.zeros(len(has))
            if texts and parser.languages:
                lang[has], score[has] = _decided(parser.costs(texts), parser.languages)
            yield from pa.table([t.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]).to_batches()

    return map_arrow(docs.select("doc_id", folded(F.col("text")).alias("t")), predict, "doc_id long, lang_pred string, score double")


def _over_blocks(docs: DataFrame, shared: list[Broadcast]) -> DataFrame:
    """The same with a pass for each block of languages; a task holds the automata of one block."""
    rows = docs.select("doc_id", row_key().alias("text_key"), folded(F.col("text")).alias("t"))
    every = None
    for n, block in enumerate(shared):
        part = map_arrow(rows, _block_costs(block), "doc_id long, text_key long, costs array<struct<bits: double, lang: string>>").withColumn("block", F.lit(n))
        every = part if every is None else every.unionByName(part)
    each = every.groupBy("doc_id", "text_key", "block").agg(F.count("*").cast("int").alias("copies"), F.first("costs").alias("costs"))
    whole = each.groupBy("doc_id", "text_key").agg(F.max("copies").alias("copies"), F.flatten(F.collect_list("costs")).alias("costs")).withColumn("best", F.array_min("costs"))
    weights = F.transform("costs", lambda x: F.pow(F.lit(2.0), F.col("best.bits") - x["bits"]))
    score = F.when(F.col("best").isNull(), 0.0).otherwise(1 / F.aggregate(weights, F.lit(0.0), lambda a, x: a + x))
    out = whole.select("doc_id", F.coalesce("best.lang", F.lit("und")).alias("lang_pred"), score.alias("score"), F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return out.drop("copy")


def _block_costs(shared: Broadcast) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = CrossParser(shared.value)
        kind = pa.list_(pa.struct([("bits", pa.float64()), ("lang", pa.string())]))
        for t in _in_lanes(batches):
            has, texts = _texts(t)
            costs: list[list[dict]] = [[] for _ in has]
            if texts:
                for i, row in zip(np.flatnonzero(has), parser.costs(texts).tolist(), strict=True):
                    costs[i] = [{"bits": b, "lang": x} for b, x in zip(row, parser.languages, strict=True)]
            yield from pa.table([t.column(0), t.column(1), pa.array(costs, kind)], ["doc_id", "text_key", "costs"]).to_batches()

    return count


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    learned = sample_blocks(docs.where(fold != 2).select("lang", "text"))
    return identify(docs, learned).select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": op10_language_id}
ORACLES: dict[str, str] = {}

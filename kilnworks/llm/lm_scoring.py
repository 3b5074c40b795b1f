"""Language-model scores: a unigram model over subword pieces, summed over all segmentations of each word.

The pieces and their first scores come from an existing vocabulary (a sentencepiece model, whose scores are ranks;
rank r starts at a weight of 1 / (r + 3)). Two rounds of expectation maximisation over the word counts of the learning
documents turn them into probabilities: every word's lattice gives the expected uses of each piece. A word's
probability is the sum over its segmentations (log-space forward recursion); a document's is the product over its
words and one end token. Bytes stand in for what no piece covers, so every text has a probability.

Words are lower-case A-Z runs between white space. No table of words is broadcast or collected: each task writes its
documents as numbers into a word list of its own ("block") together with that list; counts and word scores are joined
to the lists by word, go back by block, and only then are documents summed. What is broadcast are the pieces, whose
number the vocabulary fixes.

Edge cases: null and empty texts are one end token; words that no learning document holds count 0 and are scored by
their lattice; a null id is a learning document; repeated rows are scored and counted each; without learning documents
the probabilities are the vocabulary's; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kilnworks.llm.lattice import Lattice
from kilnworks.llm.scratch import cut
from kilnworks.llm.token_counts import MARK, MODEL, read_pieces

ROUNDS = 2
#: Bytes of text after which a task starts a new block, and so a new word list.
BLOCK_BYTES = 32 << 20
#: Uses that every piece is given beyond those counted.
FLOOR = 0.01
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_ROW = "block long, kind tinyint, doc_id long, held_out boolean, ids binary, word binary, n long"


def words(text: str | None) -> list[bytes]:
    """Lower-case words as UTF-8; bytes.split() parts at just the six ASCII white-space characters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def _batch(block: int, kind: int, **columns) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "ids": pa.binary(), "word": pa.binary(), "n": pa.int64()}
    given = [pa.array(columns[k], t) if k in columns else pa.nulls(rows, t) for k, t in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array([block] * rows, pa.int64()), pa.array([kind] * rows, pa.int8()), *given], names=["block", "kind", *kinds])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents as numbers of words (kind 1), and each block's words in the order of their numbers (kind 0)."""
    task, blocks = TaskContext.get().partitionId(), 0
    known: dict[bytes, int] = {}
    learnt: list[int] = []
    size = 0

    def close() -> Iterator[pa.RecordBatch]:
        listed = list(known)
        for k in range(0, len(listed), 50_000):
            ids = np.arange(k, min(k + 50_000, len(listed)), dtype=np.int32)
            yield _batch(task << 24 | blocks, 0, ids=[i.tobytes() for i in ids], word=listed[k : k + 50_000], n=learnt[k : k + 50_000])

    for batch in batches:
        done: list[tuple] = []
        for doc, held, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            found = words(text)
            ids = np.fromiter((known.setdefault(w, len(known)) for w in found), dtype=np.int32, count=len(found))
            learnt.extend([0] * (len(known) - len(learnt)))
            if not held:
                for i in ids.tolist():
                    learnt[i] += 1
            done.append((doc, held, ids.tobytes()))
            size += len(text or "")
            if size >= BLOCK_BYTES:
                d, h, raw = zip(*done, strict=True)
                yield _batch(task << 24 | blocks, 1, doc_id=d, held_out=h, ids=raw)
                yield from close()
                done, size, blocks = [], 0, blocks + 1
                known.clear()
                learnt.clear()
        if done:
            d, h, raw = zip(*done, strict=True)
            yield _batch(task << 24 | blocks, 1, doc_id=d, held_out=h, ids=raw)
    yield from close()


def _first_lattice(path: str) -> Lattice:
    """The vocabulary's pieces with probabilities from their ranks; single bytes that are no pieces come last."""
    pieces = list(dict.fromkeys(read_pieces(path)))
    pieces += [b for k in range(256) if (b := bytes([k])) not in set(pieces)]
    weight = 1 / (np.arange(len(pieces)) + 3.0)
    return Lattice(pieces, np.log(weight / weight.sum()))


def _fit(counts: DataFrame, lattice: Lattice, ends: int, rounds: int) -> tuple[Lattice, float]:
    """The lattice after some rounds over (word, c), and the log probability of the end token."""
    sc = counts.sparkSession.sparkContext
    start = MARK.encode()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    if not total:
        return lattice, float(np.log(0.5))
    p_end = 0.0
    for _ in range(rounds):
        shared = sc.broadcast((lattice.pieces, lattice.logp))

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = Lattice(*shared.value)
            uses = np.zeros(len(mine.pieces))
            for batch in batches:
                mine.log_probability([start + w for w in batch.column(0).to_pylist()], batch.column(1).to_numpy().astype(np.float64), uses)
            used = np.flatnonzero(uses)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(uses[used])], names=["piece", "uses"])

        got = counts.filter("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses"))
        uses = np.full(len(lattice.pieces), FLOOR)
        for r in got.collect():  # a row for each piece of the vocabulary at most
            uses[r["piece"]] += r["uses"]
        all_uses = uses.sum() + ends
        lattice = Lattice(lattice.pieces, np.log(uses / all_uses))
        p_end = ends / all_uses
    return lattice, float(np.log(max(p_end, 1e-300)))


def score(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text", model: str = MODEL, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one word unigrams) and score (log10 probabilities)."""
    spark = docs.sparkSession
    given = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text).alias("text"))
    table = cut(given.mapInArrow(_number, _ROW), "numbered")
    listed = table.filter("kind = 0").select("block", "ids", "word", "n")
    counts = cut(listed.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    ends = table.filter("kind = 1 AND NOT held_out").count()
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    tokens, kinds = n + ends, v + (1 if ends else 0)
    lattice, log_end = _fit(counts, _first_lattice(model), ends, rounds)
    shared = spark.sparkContext.broadcast((lattice.pieces, lattice.logp))
    start, ln10 = MARK.encode(), np.log(10)

    def word_scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Lattice(*shared.value)
        for batch in batches:
            s = mine.log_probability([start + w for w in batch.column(0).to_pylist()]) / ln10
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s)], names=["word", "c", "s"])

    scored = counts.mapInArrow(word_scores, "word binary, c long, s double")
    looked_up = listed.join(scored, "word").select("block", F.lit(0).cast("tinyint").alias("kind"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), "ids", "c", "s")
    numbered = table.filter("kind = 1").select("block", "kind", "doc_id", "held_out", "ids", F.lit(None).cast("long").alias("c"), F.lit(None).cast("double").alias("s"))
    end_base, end_known = float(np.log10((ends + 1) / (tokens + kinds + 1))), int(ends > 0)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks one after the other, each with its words first."""
        block, parts = None, []
        base = known = own = None
        for batch in batches:
            blocks, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    if blocks[a] != block:
                        block, parts, base = blocks[a], [], None
                    ids = np.frombuffer(b"".join(part.column(4).to_pylist()), np.int32)
                    parts.append((ids, part.column(5).to_numpy(), part.column(6).to_numpy()))
                    continue
                if blocks[a] != block:  # a block whose documents hold no word
                    block, parts, base = blocks[a], [], None
                if base is None:
                    ids, c, s = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(3))
                    order = np.argsort(ids)
                    base, known, own = np.log10((c[order] + 1) / (tokens + kinds + 1)), c[order] > 0, s[order]
                rows = [np.frombuffer(x, np.int32) for x in part.column(4).to_pylist()]
                sums = [(len(r) + 1, int(known[r].sum()) + end_known if len(r) else end_known, float(base[r].sum()) + end_base if len(r) else end_base, (float(own[r].sum()) if len(r) else 0.0) + log_end / ln10) for r in rows]
                size, seen, plain, sub = zip(*sums, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2), part.column(3), pa.array(size, pa.int64()), pa.array(seen, pa.int64()), pa.array([tokens] * len(rows), pa.int64()), pa.array(plain), pa.array(sub)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    together = looked_up.unionByName(numbered).repartition("block").sortWithinPartitions("block", "kind")
    return together.mapInArrow(gather, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")

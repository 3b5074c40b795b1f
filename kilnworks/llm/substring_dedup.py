"""Suffix-array dedup: bytes covered by a long string that stands anywhere else are removed, all occurrences included.

1. Every string of `size` bytes has a minimizer: the k-gram inside it of least hash. Equal strings have equal ones, so
   strings can only repeat where a minimizer repeats. Consecutive strings with the same minimizer form a segment; a
   document is a chain of segments.
2. Segments are counted by minimizer and content. A segment whose content stands twice is repeated as a whole. One that
   stands once, but shares its minimizer with other contents, may be repeated in part.
3. Of each content under such a minimizer one copy goes to a shard: suffix arrays by Larsson-Sadakane refinement, common
   prefixes by Kasai's scan, strings repeated where `size` bytes or more are shared. Minimizers with more text than a
   shard holds are dealt into pairs of shards that are merged by binary search, so no task holds more than two.
4. Repeated strings become spans of their documents, which are cut out of the texts.

Edge cases: null is empty; texts shorter than `size` lose nothing; matches never cross documents; repeated rows lose
everything that is `size` bytes or longer; rows of one id with different texts are kept apart; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.llm.bytetext import blocks, mix, powers, prefix_hashes, span_hashes
from kilnworks.llm.scratch import cut
from kilnworks.llm.suffixes import Shard

SIZE = 200
GRAM = 48
#: Bytes of segments in a shard; a minimizer with more is dealt out.
SHARD = 1 << 20
#: A content that holds more than one in this many segments is joined by broadcast; there are fewer than this many.
HOT = 1000
_PLACE_BITS = np.uint64(32)  # a text has less than 2 GiB
_SECOND = np.uint64(0xD6E8FEB86659FD93)


def segments(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, first string, last string, minimizer hash, content hash) of the segments of some texts, positions from the text's start."""
    n = len(data)
    none = np.zeros(0, dtype=np.int64)
    if n < size:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    prefix = prefix_hashes(data)
    at = np.arange(n - gram + 1)
    grams = mix(span_hashes(prefix, at, at + gram))
    # The upper bits of the hash, then the place: the least of a window is its leftmost least gram.
    low = (grams >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
    width, span = size - gram + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    low = np.minimum(low[: n - size + 1], low[width - span : width - span + n - size + 1])
    chosen = (low & np.uint64((1 << 32) - 1)).astype(np.int64)
    text = np.searchsorted(offsets, np.arange(n - size + 1), side="right") - 1
    whole = np.arange(n - size + 1) + size <= offsets[text + 1]
    new = np.ones(len(chosen), dtype=bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new & whole)
    ends = np.flatnonzero(np.append(new[1:], True) | ~np.append(whole[1:], False))
    last = ends[np.searchsorted(ends, first)]
    content = mix(span_hashes(prefix, first, last + size) + (last - first).astype(np.uint64) * _SECOND)
    return text[first], first - offsets[text[first]], last - offsets[text[first]], grams[chosen[first]], content


def _find(size: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies = batch.column(0), batch.column(1)
            for first, _, data, at in blocks(batch.column(2)):
                text, a, b, low, content = segments(data, at, size, gram)
                where = pa.array(first + text)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low.view(np.int64)), pa.array(content.view(np.int64)), ids.take(where), copies.take(where), pa.array(a << 32 | b)], names=["low", "content", "doc_id", "copy", "at"]
                )

    return rows


def _cut_out(size: int):
    """The bytes of segments, given the texts and their lists of segments."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, lists = (batch.column(k).to_pylist() for k in range(3))
            for doc, copy, wanted, text in zip(ids, copies, lists, batch.column(3), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                keys = [[w[k] for w in wanted] for k in ("low", "i", "j", "shard", "whole", "at")]
                parts = [raw[at >> 32 : (at & 0xFFFFFFFF) + size] for at in keys[5]]
                types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(k, t) for k, t in zip(keys, types, strict=True)), pa.array([doc] * len(wanted), pa.int64()), pa.array([copy] * len(wanted), pa.int64()), pa.array(parts, pa.binary())],
                    names=["low", "i", "j", "shard", "whole", "at", "doc_id", "copy", "part"],
                )

    return rows


def _runs(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of the runs of true values."""
    edges = np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))
    return np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1


def _repeats(size: int, limit: int):
    """The repeated strings of segments that stand once: (doc_id, copy, first byte << 32 | byte after the last)."""

    def solve(rows: list[tuple], dealt: bool) -> Iterator[pa.RecordBatch]:
        """rows: (shard, whole, at, doc_id, copy, part)."""
        groups = [rows]
        if dealt:
            sides = sorted({r[0] for r in rows})
            groups = [[r for r in rows if r[0] == k] for k in sides]
        shards = [Shard([r[5] for r in g]) for g in groups]
        hits = [s.repeated(size) for s in shards]
        if len(shards) == 2:
            one, two = shards[0].also_in(shards[1], size)
            hits = [hits[0] | one, hits[1] | two]
        doc, copy, span = [], [], []
        for g, shard, hit in zip(groups, shards, hits, strict=True):
            for k, r in enumerate(g):
                if not r[1]:
                    for a, b in zip(*_runs(hit[shard.starts[k] : shard.ends[k]]), strict=True):
                        begin = r[2] >> 32
                        doc.append(r[3])
                        copy.append(r[4])
                        span.append((begin + int(a)) << 32 | (begin + int(b) + size))
        if doc:
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(copy, pa.int64()), pa.array(span, pa.int64())], names=["doc_id", "copy", "span"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, seen, key, held_bytes, dealt = [], set(), None, 0, False
        for batch in batches:
            for low, i, j, *row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                now = (low, i, j)
                # Groups of a minimizer share a shard until it is full; a dealt one stands alone.
                if held and now != key and (dealt or j >= 0 or held_bytes >= limit):
                    yield from solve(held, dealt)
                    held, held_bytes = [], 0
                if now != key:
                    seen.clear()
                key, dealt = now, j >= 0
                # Rows of equal id and text bring the same segment once each.
                if (place := (row[0], *row[2:5])) in seen:
                    continue
                seen.add(place)
                held.append(tuple(row))
                held_bytes += len(row[5])
        if held:
            yield from solve(held, dealt)

    return rows


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, spans, kept = [], [], []
        for text, found in zip(batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            merged: list[list[int]] = []
            for x in sorted(found.as_py() or []):
                a, b = x >> 32, x & 0xFFFFFFFF
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                else:
                    merged.append([a, b])
            edges = [0, *(x for m in merged for x in m), len(raw)]
            sizes.append(len(raw))
            spans.append([{"start": a, "end": b} for a, b in merged])
            kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _shared(found: DataFrame) -> DataFrame:
    """The segments whose minimizer stands twice or more, with whole (their content does too) and mixed (other contents
    share the minimizer).

    Counts are summed by content, then by minimizer, before anything is joined, so copies of one content never meet in
    one task. Only the contents that hold more than 1 / HOT of all segments could crowd a key of the join back; these,
    fewer than HOT, are broadcast.
    """
    contents = found.groupBy("low", "content").agg(F.count("*").alias("alike"))
    lows = contents.groupBy("low").agg(F.sum("alike").alias("all")).filter("all > 1")
    kept = contents.join(lows, "low").select("low", "content", "alike", (F.col("alike") > 1).alias("whole"), (F.col("alike") < F.col("all")).alias("mixed"))
    kept = cut(kept, "contents")
    crowd = found.count() / HOT
    hot, rest = (kept.filter(x).drop("alike") for x in (F.col("alike") > crowd, F.col("alike") <= crowd))
    many = found.join(F.broadcast(hot), ["low", "content"])
    few = found.join(F.broadcast(hot), ["low", "content"], "left_anti").join(rest, ["low", "content"])
    return many.unionByName(few)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SIZE, gram: int = GRAM, shard: int = SHARD) -> DataFrame:
    """doc_id, n_bytes, spans (removed runs: start, end) and kept (the remaining bytes) of each row."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    found = cut(docs.mapInArrow(_find(size, gram), "low long, content long, doc_id long, copy long, at long"), "found")
    counted = cut(_shared(found), "segments")

    # One copy of each content, where contents differ.
    one = counted.filter("mixed").groupBy("low", "content").agg(F.min(F.struct("doc_id", "copy", "at")).alias("r"), F.first("whole").alias("whole"))
    one = one.select("low", "content", "whole", "r.doc_id", "r.copy", "r.at", (F.shiftrightunsigned("r.at", 0).bitwiseAND(0xFFFFFFFF) - F.shiftright("r.at", 32) + size).alias("bytes"))
    parts = one.groupBy("low").agg(F.ceil(F.sum("bytes") / shard).cast("int").alias("shards"))
    one = one.join(parts, "low").withColumn("shard", F.pmod(F.xxhash64("content"), F.col("shards")).cast("int"))
    # A single shard is pair (0, -1); of several, each goes to its pairs with all the others.
    others = F.filter(F.sequence(F.lit(0), F.col("shards") - 1), lambda k: k != F.col("shard"))
    with_other = F.transform(others, lambda k: F.struct(F.least(F.col("shard"), k).alias("i"), F.greatest(F.col("shard"), k).alias("j")))
    pairs = F.when(F.col("shards") == 1, F.array(F.struct(F.lit(0).alias("i"), F.lit(-1).alias("j")))).otherwise(with_other)
    one = one.withColumn("pair", F.explode(pairs)).select("low", "pair.i", "pair.j", "shard", "whole", "at", "doc_id", "copy")
    lists = cut(one.groupBy("doc_id", "copy").agg(F.collect_list(F.struct("low", "i", "j", "shard", "whole", "at")).alias("wanted")), "wanted")
    same = lambda a, b: a["doc_id"].eqNullSafe(b["doc_id"]) & (a["copy"] == b["copy"])
    # Rows without an id are told apart by their text alone, so one of each is fetched.
    fetched = docs.filter("doc_id IS NOT NULL").union(docs.filter("doc_id IS NULL").dropDuplicates(["copy"]))
    texts = fetched.join(lists, same(fetched, lists)).select(lists["doc_id"], lists["copy"], "wanted", "text")
    cuts = texts.mapInArrow(_cut_out(size), "low long, i int, j int, shard int, whole boolean, at long, doc_id long, copy long, part binary")
    dealt = cuts.repartition("low", "i", "j").sortWithinPartitions("low", "i", "j").select("low", "i", "j", "shard", "whole", "at", "doc_id", "copy", "part")
    partly = dealt.mapInArrow(_repeats(size, shard), "doc_id long, copy long, span long")

    wholly = counted.filter("whole").select("doc_id", "copy", (F.col("at") + size).alias("span"))
    spans = cut(wholly.union(partly).groupBy("doc_id", "copy").agg(F.collect_set("span").alias("found")), "spans")
    joined = docs.join(spans, same(docs, spans), "left").select(docs["doc_id"], "text", "found")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")

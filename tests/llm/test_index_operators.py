"""Token files, whitening and the filter audit against plain Python, with their edge cases."""

import math
import zlib
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kilnworks.llm import filter_audit, token_files, wavelet, whitening


def test_wavelet_matrix_answers_like_a_list():
    rng = np.random.default_rng(5)
    for n, top in ((0, 4), (1, 2), (5000, 9), (600_000, 70_000)):
        ids = rng.integers(0, top, n).astype(np.uint32)
        ids[: n // 3] = 0
        width = max(1, (top - 1).bit_length())
        file = wavelet.WaveletFile.of(wavelet.encode(ids, [7, None, -3], np.array([n, 0, 0]), width))
        assert (file.tokens() == ids).all()
        assert file.documents()[0] == [7, None, -3]
        assert file.documents()[1].tolist() == [n, 0, 0]
        assert file.count(top + (1 << width)) == 0
        for i in rng.integers(0, n, 20 if n else 0).tolist():
            token = int(ids[i])
            places = np.flatnonzero(ids == token)
            assert file.access(i) == token
            a, b = sorted(rng.integers(0, n + 1, 2).tolist())
            assert file.count(token, a, b) == ((places >= a) & (places < b)).sum()
            k = int(rng.integers(0, len(places)))
            assert file.select(token, k) == places[k]
            near = places[(places >= i) & (places < i + 50)]
            assert file.occurrences(token, i, i + 50) == near.tolist()
        with pytest.raises(IndexError):
            file.access(n)
        with pytest.raises(IndexError):
            file.select(0, n + 1)


def test_wavelet_file_reads_few_bytes():
    ids = np.random.default_rng(1).integers(0, 60_000, 3_000_000).astype(np.uint16)
    data, read = wavelet.encode(ids, [1], np.array([len(ids)]), 16), []
    file = wavelet.WaveletFile(lambda at, size: (read.append(size), data[at : at + size])[1])
    assert file.access(2_345_678) == ids[2_345_678]
    assert sum(read) < len(data) / 5
    with pytest.raises(ValueError, match="wavelet"):
        wavelet.WaveletFile.of(b"nope" + bytes(60))


ODD = " a\tb \n\n c\x1c! d\x85 é\xa0  x  y\x00z 've '  <|endoftext|> end "


def token_rows():
    rows = [(k, ("word " * (k % 7) + f"kiln{k % 5}, firing\n").strip("\n" if k % 2 else "")) for k in range(60)]
    return rows + [(70, None), (71, ""), (72, ODD), (None, "no id"), (None, None), (5, "second row of five"), (3, rows[3][1]), (3, rows[3][1]), (-4, "x" * 3000 + " " + "déjà vu " * 900)]


def expected_tokens(rows, hashes):
    coder, at, out = Tokenizer.from_file(token_files.vocabulary()), 0, []
    for (one, text), _ in sorted(zip(rows, hashes, strict=True), key=lambda r: (r[0][0] is not None, r[0][0] or 0, r[1])):
        ids = [*coder.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((one, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard", [1 << 25, 40])
def test_token_files(spark, tmp_path, shard, monkeypatch):
    monkeypatch.setattr(token_files, "SLICE", 1 << 20 if shard > 100 else 500)
    rows = token_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"start": F.lit(1), "n_tokens": F.lit("x"), "copy": F.lit(2)}).repartition(3)
    hashes = [r[0] for r in spark.createDataFrame(rows, "doc_id long, text string").select(F.xxhash64("text")).collect()]
    files = token_files.write_files(docs, str(tmp_path / "ids"), shard_tokens=shard)
    got = token_files.read_files(files, str(tmp_path / "ids"))
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == expected_tokens(rows, hashes)
    listed = files.collect()
    assert (len(listed) > 15) == (shard == 40)
    assert sum(r.n_docs for r in listed) == len(rows)
    ends = {r.path: r.n for r in token_files.count_token(files, str(tmp_path / "ids"), 0).collect()}
    assert sum(ends.values()) == len(rows) + 1  # the exclamation mark has id 0, too
    # A file that no committed list names, as a lost attempt leaves it, changes nothing.
    (tmp_path / "ids" / "000000-0000-orphan.kwmx").write_bytes(b"half a file")
    assert token_files.read_files(files, str(tmp_path / "ids")).count() == len(rows)


def test_token_files_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert token_files.encode_documents(empty).collect() == []


def test_special_tokens_as_text(spark):
    docs = spark.createDataFrame([(1, "<|endoftext|> a")], "doc_id long, text string")
    sizes = [token_files.encode_documents(docs, special_as_text=x).first().n_tokens for x in (False, True)]
    assert sizes[0] < sizes[1]


def test_encoder_equals_the_library_when_parts_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "REMEMBERED", 2000)
    with open(token_files.vocabulary(), encoding="utf-8") as f:
        coder = token_files.Encoder(f.read())
    plain = Tokenizer.from_file(token_files.vocabulary())
    texts = [ODD, "", None, *(f"{ODD * (k % 3)} part{k} of kiln's 'll {k * 37}" for k in range(200))]
    for at in range(0, len(texts), 7):
        for text, ids in zip(texts[at : at + 7], coder.encode(texts[at : at + 7]), strict=True):
            assert np.frombuffer(ids, coder.dtype).tolist() == plain.encode(text or "", add_special_tokens=False).ids


VECTOR_SCHEMA = "vec_id long, embedding array<float>, label int, component string, n int, x string, index string, key string"


def whiten(spark, vectors, **options):
    rows = [(k, v, 1, "c", 2, "x", "i", "k") for k, v in vectors]
    return [r.asDict() for r in whitening.whiten(spark.createDataFrame(rows, VECTOR_SCHEMA), **options).collect()]


def test_whitening_equals_numpy(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 4)
    monkeypatch.setattr(whitening, "PANEL", 2)
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 1100)
    rng = np.random.default_rng(3)
    data = (rng.normal(size=(700, 6)) * [9, 5, 3, 2, 1, 0.5]).astype(np.float32)
    vectors = [(k, v) for k, v in enumerate(data.tolist())]
    vectors += [(1000 + k, data[0].tolist()) for k in range(400)] + [(None, data[1].tolist()), (3, data[2].tolist())]
    bad = [(2000, None), (2001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2002, [float("nan")] * 6), (2003, [float("inf")] * 6), (2004, [1e30] * 6)]
    vectors += [(2005, [-0.0, 0.001])]
    got = whiten(spark, vectors + bad)
    kept = [(k, (v + [0] * 6)[:6]) for k, v in vectors]
    x = np.floor(256 * np.array([v for _, v in kept], dtype=np.float64)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == 4 * len(kept)
    assert {r["n"] for r in got} == {n}
    assert max(r["identity_error"] for r in got) < 1e-10
    want = {}
    for (key, _), row in zip(kept, x, strict=True):
        for c in range(4):
            one = abs(float((row - s / n) @ axes[:, c] / math.sqrt(values[c])))
            want.setdefault((key, c + 1), []).append((int(((n * row - s) ** 2).sum()), round(one, 7)))
    mine = {}
    for r in got:
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        mine.setdefault((r["vec_id"], r["component"]), []).append((r["deviation"], round(abs(r["whitened"]), 7)))
    assert {k: sorted(v) for k, v in mine.items()} == {k: sorted(v) for k, v in want.items()}
    for c in range(1, 5):  # one sign for all rows
        pairs = [(r["whitened"], float((x[k] - s / n) @ axes[:, c - 1])) for r in got if r["component"] == c and (k := r["vec_id"]) is not None and k < 700 and k != 3]
        assert len({np.sign(a * b) for a, b in pairs if abs(b) > 1e-6}) == 1


def test_whitening_without_variance(spark):
    assert whiten(spark, []) == []
    assert whiten(spark, [(1, None), (2, [])]) == []
    alone = whiten(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])
    assert [(r["vec_id"], r["component"], r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in sorted(alone, key=lambda r: (r["vec_id"], r["component"]))] == [
        (k, c, 1, 0, None, None, None) for k in (1, 2) for c in (1, 2)
    ]
    flat = whiten(spark, [(1, [1.0, 5.0]), (2, [3.0, 5.0])])
    assert {(r["component"], r["whitened"] is None) for r in flat} == {(1, False), (2, True)}
    assert [abs(r["whitened"]) for r in flat if r["component"] == 1] == pytest.approx([1.0, 1.0])


def test_whitening_leaves_out_what_a_long_cannot_hold(spark):
    big = [(k, [float(k * 2**40), 1.0]) for k in range(4)]
    assert {r["deviation"] for r in whiten(spark, big)} == {None}


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, "x", 3) for r in rows], "doc_id long, text string, source string, n long, mask string, step int")
    marks = spark.createDataFrame([(*r, "t") for r in labels], "doc_id long, quality int, toxic int, part string")
    return {(r.part, r.filter_order, r.step): tuple(r[3:]) for r in filter_audit.audit(docs, marks).collect()}


def by_hand(rows, labels):
    good, bad = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    least = {}
    for d, t, _ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    judged = []
    for d, t, source in rows:
        t = t or ""
        words = [w for w in t.replace("\n", " ").replace("\t", " ").split(" ") if w]
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t),
            "D": any(c in "#$%&*|" for c in t), "E": d is not None and d > least[t],
        }
        judged.append((source or "", {k for k, v in fails.items() if v}, d in good, d in bad))
    out = {}
    orders = ["".join(p) for p in permutations("ABCDE")]
    for part in {j[0] for j in judged}:
        own = [j for j in judged if j[0] == part]
        shapley = {f: sum(1 for o in orders for j in own if f in j[1] and not j[1] & set(o[: o.index(f)])) for f in "ABCDE"}
        for o in orders:
            for k, f in enumerate(o):
                left = [j for j in own if not j[1] & set(o[:k])]
                gone = [j for j in left if f in j[1]]
                out[part, o, k + 1] = (len(left) - len(gone), len(gone), sum(f in j[1] for j in own) - len(gone), sum(j[1] == {f} for j in own), sum(j[2] for j in gone), sum(j[3] for j in gone), shapley[f])
    return out


@pytest.mark.parametrize("buckets", [filter_audit.BUCKETS, 1])
def test_filter_audit(spark, buckets, monkeypatch):
    monkeypatch.setattr(filter_audit, "BUCKETS", buckets)
    long = " ".join(f"w{k}" for k in range(80))
    rows = [(k, f"{long} v{k}", "a") for k in range(300)]
    rows += [(400 + k, f"{long} v5", "b") for k in range(40)] + [(2, f"{long} v5", "b"), (5, f"{long} v5", "a")]
    rows += [(500, None, None), (501, "", "a"), (None, "", "a"), (None, f"{long} v7", "a"), (502, "one two " * 60, "c"), (503, long.upper(), "c"), (504, long + " $|", "c"), (505, "A\tb\n#", "c")]
    rows += [(600, "x " * 5000, "c"), (600, "x " * 5000, "c"), (601, "é" * 19 + "A", "c"), (602, "é" * 20 + "A", "c")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 620, 5)] + [(5, 0, 1), (5, 1, None), (None, 1, 1), (9999, 1, 1), (503, None, 1)]
    assert audited(spark, rows, labels) == by_hand(rows, labels)


def test_filter_audit_of_nothing(spark):
    assert audited(spark, [], [(1, 1, 1)]) == {}
    only = audited(spark, [(1, None, None)], [])
    assert len(only) == 600
    assert only["", "ABCDE", 1] == (0, 1, 0, 1, 0, 0, 120)


def test_sketch_clears_lone_texts(spark):
    hashes = spark.range(20_000).select(F.xxhash64("id").alias("hash"))
    sketch, buckets = filter_audit.repeat_sketch(hashes.union(hashes.limit(50)), 20_050)
    found = filter_audit.possible_repeats(hashes, sketch, buckets).filter("repeats").count()
    assert 50 <= found < 400


def test_packing_spreads_rows_that_are_all_alike(spark, monkeypatch):
    from kilnworks.llm import packing

    monkeypatch.setattr(packing, "SHARD_ROWS", 100)
    docs = spark.createDataFrame([(1, "the same kiln")] * 1500 + [(2, "another kiln, longer")] * 3, "doc_id long, text string").repartition(4)
    made = packing.pack(docs, budget=12, buckets=2).collect()
    assert len(made) == 1503
    places = [(r.bucket, r.batch, r.slot) for r in made]
    assert len(set(places)) == len(places)
    by_bucket = {}
    for r in made:
        by_bucket.setdefault(r.bucket, []).append(r)
        assert r.n_tokens == len([t for t in pieces(r.doc_id)])
    for held in by_bucket.values():
        size = max(1, 12 // held[0].bucket_tokens)
        assert sorted((r.batch, r.slot) for r in held) == [(k // size, k % size) for k in range(len(held))]


def pieces(doc_id):
    """Greedy longest pieces of a word, by trying all of them."""
    from kilnworks.llm import token_counts

    known = set(token_counts.read_pieces())
    out = []
    for word in {1: "the same kiln", 2: "another kiln, longer"}[doc_id].split():
        rest = (token_counts.MARK + word).encode()
        while rest:
            n = next((k for k in range(len(rest), 0, -1) if rest[:k] in known), 1)
            out.append(rest[:n])
            rest = rest[n:]
    return out


def test_labelled_texts_are_bounded_though_ids_repeat(spark):
    from kilnworks.llm import toxicity

    seen = []
    plain = toxicity.cut

    def watched(df, name):
        made = plain(df, name)
        if name == "known":
            seen.append(made.count())
        return made

    toxicity.cut, before = watched, toxicity.cut
    try:
        docs = spark.createDataFrame([(7, f"vile rot scum {k}") for k in range(3000)] + [(k + 10, f"calm kiln glaze {k}") for k in range(30)], "doc_id long, text string")
        labels = spark.createDataFrame([(7, 1)] + [(k + 10, 0) for k in range(30)], "doc_id long, toxic int")
        model = toxicity.fit(docs, labels, rows=200)
    finally:
        toxicity.cut = before
    assert seen == [200]
    scores = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert scores[7] > scores[15]

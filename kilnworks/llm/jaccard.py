"""N-gram Jaccard join: a product of the sparse document by n-gram incidence matrix, in blocks, without its hopeless pairs.

A document is the set of its distinct runs of five words (lower-case A-Z; all of its words if fewer; nothing if it
has none). Two documents link when 100 * overlap >= percent * union. Equal sets form one class, so copies cost
nothing after the first pass.

1. Columns (n-grams) get one order for all documents: those found often go last. "Often" is counted within tasks and
   the first `FREQUENT` of them are taken; the order decides cost alone, never results.
2. A row's prefix is its first n - ceil(share * n) + 1 columns in that order, and all its low ones (not frequent, hash
   in the first LOW of the range); linked rows share a prefix column. In a column only rows whose sizes lie in one
   run, without a gap that no link can bridge, are kept. A low column of a row that no other row of the run has is
   missing from every partner, and a link leaves room for a quarter of a row at most, less if the partner misses some
   too: rows that miss more are taken out, and a row stays in a column only while some row there makes up for it.
3. In columns of at most CROWD rows the shared columns of each pair are accumulated, and pairs whose sizes, positions
   and counts leave too little room are discarded. The rows of a larger (crowded) column are held together by a star,
   without pairs. A row shares more low columns with any partner than its `spare`, so it leaves that many of its
   crowded columns, the largest: partners that share more crowded columns than either leaves still meet in the
   smallest of them, and the others are counted as if they shared as many as they may. So columns that are crowded
   by chance, of which more come up as a table grows, tie nothing together. Components of both are blocks: whatever
   links lies inside one.
4. A block goes to one task, which accumulates overlaps of whole rows (`incidence.Block`) and returns no more links
   than join its components. A block of more than BLOCK n-grams is cut by its largest columns; the parts are
   multiplied with themselves, and then the rows outside the largest component of a column visit the other parts that
   hold the column. Of two components in a column one is not the largest, so no link between components is lost.

Edge cases: null and empty texts, and texts of white space, have no n-grams and link with nothing; repeated rows are
one class; an id that stands in several rows with different texts is judged by each text; null ids never name a
component unless all ids of it are null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kilnworks.llm.bytetext import blocks, lower, mix, shingle_sets
from kilnworks.llm.components import components
from kilnworks.llm.incidence import Block
from kilnworks.llm.scratch import cut, drop
from kilnworks.llm.sketch import apart

PERCENT = 75
WINDOW = 5
#: Columns that are moved to the end of the order, at most; their hashes travel with the task.
FREQUENT = 100_000
#: Distinct sets of a batch that must hold a column before it counts as frequent.
OFTEN = 8
#: Rows up to which the pairs of a column are counted one by one.
CROWD = 32
#: The share of all hashes that every prefix covers: more than a row may miss, so that rows that share little are seen.
LOW = 0.3
#: Rounds in which rows that miss too many low columns are taken out.
ROUNDS = 2
#: Parts, by hash, in which all prefix columns are shuffled, one after the other; texts are read once for each.
SLICES = 2
#: N-grams of one block that a task holds.
BLOCK = 1 << 20
#: N-grams from which small blocks are multiplied together.
TOGETHER = 1 << 16
#: Rows of a cut column that go to all its parts.
HUBS = 8
_SALT = np.uint64(0x6A09E667F3BCC909)


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that identify a set of hashes, as two signed numbers."""
    a = mix(s).sum(dtype=np.uint64, keepdims=True).view(np.int64)[0]
    b = mix(s ^ _SALT).sum(dtype=np.uint64, keepdims=True).view(np.int64)[0]
    return int(a), int(b)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document (kind 0), and for each frequent column of a batch with its count (kind 1)."""
    seen: set[tuple[int, int]] = set()
    held: list[np.ndarray] = []
    size = 0

    def flush() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        often = n >= OFTEN
        rows = int(often.sum())
        none = pa.nulls(rows, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.ones(rows, np.int8)), none, none, pa.array(n[often].astype(np.int64)), pa.array(_signed(h[often])), none], names=["kind", "doc_id", "copy", "n", "k1", "k2"])

    for batch in batches:
        for first, last, data, at in blocks(batch.column(2)):
            sets = shingle_sets(lower(data), at, WINDOW)
            keys = [set_key(s) for s in sets]
            rows = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(rows, np.int8)),
                    batch.column(0).slice(first, last - first),
                    batch.column(1).slice(first, last - first),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()),
                    pa.array([k[1] for k in keys], pa.int64()),
                ],
                names=["kind", "doc_id", "copy", "n", "k1", "k2"],
            )
            for s, k in zip(sets, keys, strict=True):
                if len(s) and k not in seen:
                    seen.add(k)
                    held.append(s)
                    size += len(s)
            if size >= 1 << 21:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def _prefixes(frequent: np.ndarray, percent: int, part: int):
    """A function of Arrow batches of texts: h, k1, size and position (of a low column less 2^31), low columns of the row, for each prefix column of a slice once for each class of a task."""
    limit = np.uint64(int(LOW * 2**64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for _, _, data, at in blocks(batch.column(0)):
                hs, ks, ps, ls = [], [], [], []
                for s in shingle_sets(lower(data), at, WINDOW):
                    if not len(s) or (key := set_key(s)) in seen:
                        continue
                    seen.add(key)
                    n = len(s)
                    if len(frequent):
                        spot = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                        often = frequent[spot] == s
                        low = int(np.searchsorted(s[~often], limit))
                        s = np.concatenate([s[~often], s[often]])
                    else:
                        low = int(np.searchsorted(s, limit))
                    keep = max(n - -(-percent * n // 100) + 1, low)
                    place = np.arange(1, keep + 1, dtype=np.int64)
                    place[:low] |= 1 << 31
                    here = np.flatnonzero(s[:keep] % np.uint64(SLICES) == np.uint64(part))
                    hs.append(s[here])
                    ks.append(np.full(len(here), key[0], np.int64))
                    ps.append((n << 32) + place[here])
                    ls.append(np.full(len(here), low, np.int32))
                if hs:
                    yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(hs))), *[pa.array(np.concatenate(x)) for x in (ks, ps, ls)]], names=["h", "k1", "at", "low"])

    return rows


def _room(nx: Column, px: Column, ny: Column, py: Column, percent: int) -> Column:
    """Whether sizes, and the columns after a shared one, leave room for the overlap that a link asks for."""
    after = 1 + F.least(nx - px, ny - py)
    return ((100 + percent) * after >= percent * (nx + ny)) & (100 * F.least(nx, ny) >= percent * F.greatest(nx, ny))


def _met(docs: DataFrame, frequent: np.ndarray, percent: int, part: int) -> DataFrame:
    """h, k1, at, low and run of each prefix column of a slice that classes of like size share."""
    column = Window.partitionBy("h")
    found = docs.select("text").mapInArrow(_prefixes(frequent, percent, part), "h long, k1 long, at long, low int")
    found = found.withColumns({"first": F.min("k1").over(column), "last": F.max("k1").over(column)}).filter("first != last").drop("first", "last")
    by_size = column.orderBy("n", "k1")
    found = found.withColumn("n", F.shiftright("at", 32))
    found = found.withColumns({"before": F.lag("n").over(by_size), "twin": F.coalesce(F.lag("k1").over(by_size) == F.col("k1"), F.lit(False))})
    gap = F.coalesce((100 * F.col("before") < percent * F.col("n")).cast("int"), F.lit(0))
    found = found.withColumn("run", F.sum(gap).over(by_size.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).filter("NOT twin").drop("before", "twin", "n")
    return found.withColumn("many", F.count("*").over(Window.partitionBy("h", "run"))).filter("many > 1").drop("many")


def _shared(docs: DataFrame, nodes: DataFrame, frequent: np.ndarray, percent: int) -> DataFrame:
    """h, run, node, n, pos, many, busy and spare for each prefix column that classes of like size share.

    many is the rows of the run, busy the crowded columns of the row, and spare how many of these it has left.
    """
    run = Window.partitionBy("h", "run")
    # The prefix columns of a slice, and what a round has shuffled, are on disk only until the slice or round is written.
    slices = [cut(_met(docs, frequent, percent, part), "met") for part in range(SLICES)]
    found = slices[0]
    for more in slices[1:]:
        found = found.union(more)
    n, is_low = F.shiftright("at", 32), F.shiftright("at", 31).bitwiseAND(1)
    for _ in range(ROUNDS):
        missing = F.col("low") - F.sum(is_low).over(Window.partitionBy("k1"))
        found = found.withColumn("missing", missing).filter(100 * F.col("missing") <= (100 - percent) * n)
        found = found.withColumn("slack", (100 - percent) * n - (100 + percent) * F.col("missing")).drop("missing")
        found = found.withColumn("most", F.max("slack").over(run)).filter("slack >= 0 OR slack + most >= 0").drop("slack", "most")
        found = cut(found.withColumn("many", F.count("*").over(run)).filter("many > 1"), "round")
        drop(*slices)
        slices = [found]
    row = Window.partitionBy("k1")
    crowded = F.col("many") > CROWD
    # A partner has all low columns of the row but those that a link can do without.
    bound = F.greatest(F.col("low") - F.floor((100 - percent) * n / 100) - 1, F.lit(0))
    found = found.withColumns({"busy": F.sum(crowded.cast("int")).over(row), "place": F.row_number().over(row.orderBy(F.desc("many"), F.desc("h"), F.desc("run")))})
    found = found.withColumn("spare", F.least(bound, F.col("busy"))).filter(~crowded | (F.col("place") > F.col("spare")))
    found = found.join(nodes.select("k1", "node"), "k1")
    pos = F.col("at").bitwiseAND((1 << 31) - 1)
    made = cut(found.select("h", "run", "node", n.cast("int").alias("n"), pos.cast("int").alias("pos"), "many", F.col("busy").cast("int"), F.col("spare").cast("int")), "columns")
    drop(*slices)
    return made


def _hopeful(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes that meet in small columns and whose accumulated columns leave room for a link, apart from crowded columns in which both stay."""
    few = shared.filter(F.col("many") <= CROWD).drop("many")
    side = lambda k: few.select("h", "run", F.col("node").alias(k), *[F.col(c).alias(f"{c[0]}{k}") for c in ("n", "pos", "busy", "spare")])
    like = 100 * F.least("na", "nb").cast("long") >= percent * F.greatest("na", "nb")
    met = side("a").join(side("b"), ["h", "run"]).filter((F.col("a") < F.col("b")) & like)
    room = _room(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), percent)
    left = F.least(F.greatest("sa", "sb"), "ba", "bb")  # crowded columns that they may share without meeting in one
    made = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c"), F.max("pa").alias("pa"), F.max("pb").alias("pb"), F.max(room).alias("room"), F.max(left).alias("left"))
    # Beyond the columns counted, a pair can share what follows the last of them, and no more than one side's columns outside its prefix.
    outside = F.greatest(*[F.ceil(F.col(k) * percent / 100) - 1 for k in ("na", "nb")])
    most = F.col("c") + F.col("left") + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"), outside)
    return made.filter((F.col("room") | (F.col("left") > 0)) & ((100 + percent) * most >= percent * (F.col("na") + F.col("nb")))).select("a", "b")


def _stars(shared: DataFrame) -> DataFrame:
    """The rows of each crowded column, tied to the least of them."""
    crowded = shared.filter(F.col("many") > CROWD).select("h", "run", "node")
    least = crowded.groupBy("h", "run").agg(F.min("node").alias("b"))
    return crowded.join(least, ["h", "run"]).filter("node != b").select(F.col("node").alias("a"), "b").distinct()


def _products(percent: int):
    """A function of Arrow batches sorted by block: the pairs (a, b) that join the components of each block."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, guests, size = None, {}, False, 0

        def flush() -> Iterator[pa.RecordBatch]:
            if len(held) > 1:
                names = list(held)
                block = Block([held[x][0] for x in names], np.array([held[x][1] for x in names]), percent)
                made = block.links(np.array([held[x][2] for x in names]) if guests else None)
                if made:
                    x = np.array(names)[np.array(made)]
                    yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], names=["a", "b"])

        for batch in batches:
            for first, last, data, at in blocks(batch.column(0)):
                sets = shingle_sets(lower(data), at, WINDOW)
                lists = [batch.column(k).slice(first, last - first).to_pylist() for k in range(1, 8)]
                for s, node, label, k1, k2, g1, g2, guest in zip(sets, *lists, strict=True):
                    # Blocks with guests stay apart; others are multiplied together while they are small.
                    if (g1, g2) != key and (guest is not None or size >= TOGETHER):
                        yield from flush()
                        held, size = {}, 0
                    key, guests = (g1, g2), guest is not None
                    if node not in held and set_key(s) == (k1, k2):
                        held[node] = (s, label, guest)
                        size += len(s)
        yield from flush()

    return rows


def _links(docs: DataFrame, roles: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Links inside the blocks that roles (node, label, g1, g2, guest) name; guest is null where all pairs of a block count."""
    fetch = cut(roles.join(nodes, "node").select("node", "label", "k1", "k2", "g1", "g2", "guest", F.col("rep.doc_id").alias("id"), F.col("rep.copy").alias("of")), "wanted")
    texts = apart(docs.withColumn("copy", F.xxhash64("text")), fetch.select(F.col("of").alias("copy")), "copy")[1]
    # Hashed at every size: a plan that depends on the size of the list would be another one at scale.
    found = texts.join(fetch.hint("shuffle_hash"), (F.col("copy") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")))
    found = found.select("text", "node", "label", "k1", "k2", "g1", "g2", "guest").repartition("g1", "g2").sortWithinPartitions("g1", "g2")
    made = cut(found.mapInArrow(_products(percent), "a long, b long"), "found")
    drop(fetch)
    return made


def _parts(shared: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, n, component, part) of the blocks that are cut, and the hubs (node, component, part) that go to other parts.

    Each row follows the largest column within two steps of it; the rows of one such column are one part, or are dealt
    into several that get the same hubs.
    """
    rank = F.struct("many", "h", "run")
    rows = shared.join(wide, "node").select("node", "n", "component", "h", "run", rank.alias("rank"))
    top = rows.groupBy("node").agg(F.max("rank").alias("top"))
    best = rows.join(top, "node").groupBy("h", "run").agg(F.max("top").alias("best"))
    led = rows.join(best, ["h", "run"]).groupBy("node", "n", "component").agg(F.max("best").alias("lead"))
    led = led.withColumn("lead", F.xxhash64("component", "lead"))
    order = lambda s: F.min(F.struct(F.xxhash64(F.lit(s), "node"), F.col("node").alias("node")))["node"]
    held = led.groupBy("component", "lead").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"), F.array_distinct(F.array(*[order(s) for s in range(HUBS)])).alias("hubs"))
    home = led.join(held.select("lead", "parts"), "lead").select("node", "n", "component", F.xxhash64("lead", F.pmod(F.xxhash64("node"), "parts")).alias("part"))
    hubs = held.filter("parts > 1").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    hubs = hubs.select(F.explode("hubs").alias("node"), "component", F.xxhash64("lead", F.col("k").cast("long")).alias("part"))
    return cut(home, "home"), cut(hubs, "hubs")


def _visits(shared: DataFrame, home: DataFrame, joined: DataFrame) -> DataFrame:
    """Roles of the second step: rows outside the largest component of a column visit the other parts that hold it."""
    home = home.join(joined.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    rows = shared.select("h", "run", "node").join(home, "node")
    by = rows.groupBy("h", "run", "label").agg(F.count("*").alias("c"))
    mixed = by.groupBy("h", "run").agg(F.count("*").alias("labels"), F.max(F.struct("c", "label"))["label"].alias("main")).filter("labels > 1").drop("labels")
    rows = cut(rows.join(mixed, ["h", "run"]), "mixed")
    spots = rows.select("h", "run", "component", F.col("part").alias("other")).distinct()
    guests = rows.filter("label != main").drop("component").join(spots, ["h", "run"]).filter("part != other").select("node", "n", "label", "component", F.col("other").alias("part")).distinct()
    guests = cut(guests, "guests")
    sizes = guests.groupBy("component", "part").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("parts"))
    placed = guests.join(sizes, ["component", "part"]).withColumn("k", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    hosts = rows.select("node", "label", "component", "part").distinct().join(sizes, ["component", "part"])
    hosts = hosts.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    role = lambda df, guest: df.select("node", "label", F.col("component").alias("g1"), F.xxhash64("part", "k").alias("g2"), F.lit(guest).alias("guest"))
    return role(placed, True).union(role(hosts, False))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, copy (hash of the text), n_shingles, component_id and representative for each row of docs.

    component_id is the least id that links reach; exactly the rows with the least (id, copy) of a component are its
    representatives, and they are repeated rows of each other.
    """
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    survey = cut(docs.select("doc_id", F.xxhash64("text").alias("copy"), "text").mapInArrow(_survey, "kind tinyint, doc_id long, copy long, n long, k1 long, k2 long"), "survey")
    top = survey.filter("kind = 1").groupBy("k1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "k1").limit(FREQUENT).select("k1")
    frequent = np.sort(np.array([r[0] for r in top.collect()], dtype=np.int64).view(np.uint64))
    rows = survey.filter("kind = 0").drop("kind")
    classes = rows.filter("n > 0").groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "copy")).alias("rep"), F.min("doc_id").alias("least"), F.max("n").alias("n"))
    nodes = cut(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # numbers of this table, fixed once written

    shared = _shared(docs, nodes, frequent, percent)
    held = cut(components(_hopeful(shared, percent).union(_stars(shared))).join(nodes.select("node", "n"), "node"), "blocks")
    wide = held.groupBy("component").agg(F.sum("n").alias("size")).filter(F.col("size") > BLOCK).select("component")
    wide = cut(held.join(wide, "component").select("node", "component"), "wide")
    alone = F.lit(None).cast("boolean").alias("guest")
    roles = held.join(wide.select("component").distinct(), "component", "left_anti").select("node", F.col("node").alias("label"), F.col("component").alias("g1"), F.lit(0).cast("long").alias("g2"), alone)
    if wide.isEmpty():
        links = _links(docs, roles, nodes, percent)
    else:
        home, hubs = _parts(shared, wide)
        dealt = home.select("node", "component", "part").union(hubs).distinct()
        roles = roles.union(dealt.select("node", F.col("node").alias("label"), "component", "part", alone))
        links = _links(docs, roles, nodes, percent)
        links = links.union(_links(docs, _visits(shared, home, cut(components(links), "joined")), nodes, percent))
    joined = cut(components(links), "joined")
    drop(shared, held, wide)

    whole = nodes.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = whole.groupBy("component").agg(F.min("least").alias("component_id"), F.min("rep").alias("head"))
    placed = whole.drop("n").join(heads, "component").select("k1", "k2", "component_id", "head")
    out = rows.join(placed, ["k1", "k2"], "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        "copy",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        (alone | F.struct("doc_id", "copy").eqNullSafe(F.col("head"))).alias("representative"),
    )

"""N-gram Jaccard join in the metric space of shingle sets.

The size of the symmetric difference is a metric on sets, and sets of a Jaccard
similarity above the threshold differ in few shingles for their sizes. Pivots
divide the documents into regions of this space, linked documents meet in a
region, and regions are joined exactly.

Which pivots can be near a document is found without comparing it to all of
them. The shingles of a set are dealt into slots by their hashes, somewhat more
slots than a linked set can differ in shingles. A difference changes one slot
at most, so linked sets agree in some slots; of the slots, in one order for all
sets (those with most shingles first), each set shows one more than may differ,
and linked sets show one in common (``signatures`` has the argument). A shown slot
holds several shingles, and slots that very many sets have are shown last, so sets that
merely share a passage rarely agree in one, however large the corpus. The least set that shows a slot is the pivot of
all that show it: two linked documents are in a region together.

A region is first measured against its pivot: by sketches (parities of classes of
shingles, which bound the difference of two sets from below) and exactly where
they allow a link. Links found join documents to components, and a region whose
documents are all connected is done. The others are divided again, as long as
they are large: into bands of size, where a document enters its own band and, as
a boundary document, the next one up (linked sizes are that close); then into the
Voronoi regions of pivots drawn from them, where a document goes to its
nearest pivot, its home, and to every pivot that is farther by no more than twice the
distance of a link: by the triangle inequality a document linked to one at home there
can be no farther away. The pieces are divided by new pivots in turn. Small
pieces, and those that pivots do not divide (dealt into blocks then), are
compared by sketches and, where these allow a link, exactly. Links come out as a
spanning forest, never as all pairs of a group. Equal sets are one class and
are not compared with each other.

Defined results: A-Z count as a-z; a null, empty or blank text has no
shingles and links with nothing, not even with others like it; a row without
doc_id takes no part and has no component; rows that repeat a doc_id are rows
of their own, by their own texts; other columns are ignored; an empty table gives
an empty one. Sets are named by 63 bits of a cryptographic hash, shingles by
64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import cut, join_small, returning_memory, stored
from .components import components

#: Members of a region that are compared without dividing it; and rows, and shingles, in a block of a region that pivots do not divide.
LEAF, BLOCK, WEIGHT = 64, 512, 1_500_000
#: Pivots that are drawn from a region, about; pieces that its members enter on average, and the share of it that a piece
#: may have, if it is to be divided.
PIVOTS, WINDOWS, DIVIDED = 8, 3, 0.7
#: Slots over the shingles that a linked set can differ in.
SLACK = 1.25
#: Slots that a task counts at a time; sets of a slot from which it counts as common; and common slots that are kept (8 bytes each).
HELD, OFTEN, COMMON = 1_000_000, 64, 1 << 20
SUMMARY = pa.schema({"doc_id": pa.int64(), "mark": pa.int64(), "name": pa.int64(), "n": pa.int64(), "sketch": pa.binary(), "key": pa.int64(), "count": pa.int64()})
SUMMARY_DDL = "doc_id long, mark long, name long, n long, sketch binary, key long, count long"


NONE = np.empty(0, np.uint64)


def _slots(sets: np.ndarray, firsts: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """By class: (key, shingles held, index in ``rows``, place) of each slot, rows, and the shingles a linked set can differ in."""
    n = np.diff(firsts)
    k = np.log2(np.maximum(n, 1)).astype(np.int64)
    top = (1 << k) - 1  # the largest size of the class below
    own = (n * (100 - percent)) // percent
    below = np.where((k > 0) & (percent * n <= 100 * top), ((100 - percent) * (top + n)) // (100 + percent), 0)
    for level, differ in ((k, own), (k - 1, below)):
        rows = np.flatnonzero(differ > 0)
        level, size = level[rows], n[rows]
        slots = np.ceil(SLACK * (((2 << level) - 1) * (100 - percent) // percent + 1)).astype(np.int64)
        begin = np.cumsum(slots) - slots
        row = np.repeat(np.arange(len(rows)), size)
        shingle = sets[np.arange(len(row)) + np.repeat(firsts[:-1][rows] - (np.cumsum(size) - size), size)]
        slot = begin[row] + (((shingle >> np.uint64(32)) * slots[row].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        total = int(slots.sum())
        content, held = np.zeros(total, np.uint64), np.bincount(slot, minlength=total)
        np.add.at(content, slot, vectors.mix(shingle))
        owner = np.repeat(np.arange(len(rows)), slots)
        place = np.arange(total) - begin[owner]
        tag = (place.astype(np.uint64) << np.uint64(6)) | level[owner].astype(np.uint64)
        yield vectors.mix(content + vectors.mix(tag)), held, owner, place, rows, differ[rows]


def signatures(sets: np.ndarray, firsts: np.ndarray, percent: int, common: np.ndarray = NONE) -> tuple[np.ndarray, np.ndarray]:
    """(key of a slot, row that shows it): unequal linked sets share one.

    Let D bound the shingles in which a set of n differs from any linked one;
    D = (100 - percent) / percent * n, as the larger of the two has at most
    100 / percent times the shingles of the smaller. Sizes fall into classes
    [2^k, 2^(k+1)), with more than the largest D of the class as slots. As sets
    of (slot, content), two linked sets of one class differ in D places at most,
    so in any one order the first D + 1 of each have one in common (the prefix
    filter). A pair across two classes meets in the lower one, in which the sets
    just above it take part a second time. Sets with D < 1 are linked to equal ones
    only and show nothing. The order has the ``common`` keys (sorted) last, so that
    passages that many documents share are not shown, and then the slots with most
    shingles first.
    """
    keys, owners = [NONE], [np.empty(0, np.int64)]
    for key, held, owner, place, rows, differ in _slots(sets, firsts, percent):
        at = np.searchsorted(common, key)
        late = common[np.minimum(at, len(common) - 1)] == key if len(common) else np.zeros(len(key), bool)
        order = np.argsort((owner << 9) | (late.astype(np.int64) << 8) | (255 - np.minimum(held, 255)), kind="stable")
        shown = order[place <= differ[owner]]  # sorted within rows, so the places serve as ranks
        keys.append(key[shown])
        owners.append(rows[owner[shown]])
    return np.concatenate(keys), np.concatenate(owners)


def sketches(sets: np.ndarray, firsts: np.ndarray) -> list[bytes]:
    """Parities of the classes of every row's shingles, as bits: a power of two of them, two for each shingle or more.

    Two sets differ in at least as many shingles as their sketches in bits.
    """
    n = np.diff(firsts)
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(2 * n, 64))).astype(np.int64) - 6)  # in 64-bit words
    begin = np.cumsum(width) - width
    row = np.repeat(np.arange(len(n)), n)
    word = begin[row] + ((sets >> np.uint64(6)) & (width[row] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.zeros(int(width.sum()), np.uint64)
    np.bitwise_xor.at(bits, word, np.uint64(1) << (sets & np.uint64(63)))
    return [bits[b : b + w].tobytes() for b, w in zip(begin, width, strict=True)]


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Sketches (one per row) as sketches of fewer words."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


def _sets(column: pa.Array, words: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a text column: first and last row, shingles, first shingle of each row, set names."""
    for at, to in vectors.slices(column):
        sets, firsts = vectors.shingles(*vectors.words(column.slice(at, to - at)), words)
        raw = sets.tobytes()
        names = [hashlib.blake2b(raw[8 * a : 8 * b], digest_size=8).digest() for a, b in zip(firsts[:-1], firsts[1:], strict=True)]
        yield at, to, sets, firsts, np.frombuffer(b"".join(names), dtype=np.int64) >> 1  # room for a sign


def _counted(keys: list[np.ndarray]) -> pa.RecordBatch:
    """Rows of the keys that occur more than once."""
    key, count = np.unique(np.concatenate([NONE, *keys]), return_counts=True)
    key, count = key[count > 1].view(np.int64), count[count > 1]
    nothing = [pa.nulls(len(key), t) for t in SUMMARY.types[:5]]
    return pa.RecordBatch.from_arrays([*nothing, pa.array(key), pa.array(count)], SUMMARY.names)


def _summaries(words: int, percent: int) -> Callable:
    """Name, size and sketch of each row's set, and the slots that occur more than once among HELD slots of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        for b in batches:
            for at, to, sets, firsts, names in _sets(b["text"], words):
                ids, marks = (b[c].slice(at, to - at) for c in ("doc_id", "mark"))
                nothing = [pa.nulls(len(ids), pa.int64())] * 2
                sketch = pa.array(sketches(sets, firsts), pa.binary())
                yield pa.RecordBatch.from_arrays([ids, marks, pa.array(names), pa.array(np.diff(firsts)), sketch, *nothing], SUMMARY.names)
                _, first = np.unique(names, return_index=True)  # a copy adds nothing
                keys += [key[np.isin(rows, first)[owner]] for key, _, owner, _, rows, _ in _slots(sets, firsts, percent)]
                if sum(map(len, keys)) >= HELD:
                    yield _counted(keys)
                    keys = []
        yield _counted(keys)

    return run


def common_slots(found: DataFrame) -> np.ndarray:
    """The keys of slots that very many sets have, sorted: COMMON at most, the most frequent ones.

    A slot is counted where it occurs more than once in a task, so what very many
    sets have is counted over all documents. Which slots these are decides how much is
    compared, never what is found.
    """
    often = found.where("key is not null").groupBy("key").agg(F.sum("count").alias("n")).where(F.col("n") >= OFTEN)
    rows = often.orderBy(F.desc("n"), "key").limit(COMMON).select("key").toArrow()
    return np.sort(rows["key"].to_numpy().view(np.uint64))


def _signed(words: int, percent: int, common: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, sets, firsts, names in _sets(b["text"], words):
                keys, owners = signatures(sets, firsts, percent, common.value)
                _, first = np.unique(names, return_index=True)
                keep = np.isin(owners, first)
                yield pa.RecordBatch.from_arrays([pa.array(keys[keep].view(np.int64)), pa.array(names[owners[keep]])], ["key", "name"])

    return run


def _packed(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, to, sets, firsts, names in _sets(b["text"], words):
                right = np.flatnonzero(names == b["name"].slice(at, to - at).to_numpy())  # not another text under this doc_id
                right = right[np.unique(names[right], return_index=True)[1]]
                raw = sets.tobytes()
                packed = [raw[8 * firsts[i] : 8 * firsts[i + 1]] for i in right]
                yield pa.RecordBatch.from_arrays([pa.array(names[right]), pa.array(packed, pa.binary())], ["name", "shingles"])

    return run


def _bits(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _close(percent: int) -> Callable:
    """The pairs of a document and a pivot whose sketches allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            apart = []
            for x, p in zip(b["sketch"], b["center"], strict=True):
                x, p = _bits(x), _bits(p)
                both = min(len(x), len(p))
                apart.append(int(np.bitwise_count(folded(x, both) ^ folded(p, both)).sum()))
            n = b["n"].to_numpy() + b["center_n"].to_numpy()
            keep = pa.array(np.array(apart, np.int64) * (100 + percent) <= (100 - percent) * n)
            yield pa.RecordBatch.from_arrays([b["pivot"].filter(keep), b["name"].filter(keep)], ["pivot", "name"])

    return run


def _by_unit(of_unit: Callable[[pa.Table], pa.RecordBatch]) -> Callable:
    """Apply a function to each unit; rows come sorted by unit, and a unit's rows may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            unit = batch["unit"].to_numpy()
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1), len(unit)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if held and held[-1]["unit"][0].as_py() != unit[a]:
                    yield of_unit(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield of_unit(pa.Table.from_batches(held))

    return run


def _measured(percent: int) -> Callable:
    """The pairs of a document and its unit's pivot that are linked."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        sets = {name.as_py(): _bits(v) for name, v in zip(t["name"], t["shingles"], strict=True)}
        found = []
        for pivot, name in zip(t["pivot"].to_pylist(), t["name"].to_pylist(), strict=True):
            x, p = sets[name], sets.get(pivot)
            if p is not None and name != pivot:
                both = len(np.intersect1d(x, p, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(p) - both):
                    found.append((pivot, name))
        a, b = (pa.array([f[k] for f in found], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return _by_unit(pairs)


def _windows(percent: int) -> Callable:
    """The Voronoi regions that a member enters: its nearest pivot's (``home``), and those within the window (``near``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, home = [], []
            most, width = b["most"].to_numpy(), b["width"].to_numpy()
            for x, centers, m, w in zip(b["sketch"], b["centers"], most, width, strict=True):
                x = folded(_bits(x), w)
                apart = np.array([np.bitwise_count(x ^ folded(_bits(c), w)).sum() for c in centers], np.int64)
                near.append(np.flatnonzero(apart <= apart.min() + 2 * ((100 - percent) * 2 * m // (100 + percent))).astype(np.int32))
                home.append(int(apart.argmin()))
            kept = b.drop_columns(["centers"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(near, pa.list_(pa.int32())), pa.array(home, pa.int32())], [*kept.schema.names, "near", "home"]
            )

    return run


def unit_possible(n: np.ndarray, bits: list[np.ndarray], label: np.ndarray, core: np.ndarray, part: np.ndarray, percent: int) -> np.ndarray:
    """Rows whose sketch allows a link to a row of another label and part, one of the two at home."""
    width, out = np.array([len(x) for x in bits]), np.zeros(len(bits), bool)
    for w in np.unique(width):
        at = np.flatnonzero(width >= w)
        table = np.stack([folded(bits[i], w) for i in at])
        for i, row in zip(at, table, strict=True):
            if width[i] > w:
                continue
            apart = np.bitwise_count(table ^ row).sum(axis=1, dtype=np.int64)
            hit = apart * (100 + percent) <= (100 - percent) * (n[at] + n[i])
            hit &= (label[at] != label[i]) & (part[at] != part[i]) & (core[at] | core[i])
            out[at[hit]] = True
            out[i] |= hit.any()
    return out


def unit_links(sets: list[np.ndarray], label: np.ndarray, core: np.ndarray, part: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Pairs of rows whose sets are linked, as many as connect the labels that the links connect.

    Only pairs of different labels and parts count, and of them those with a row at home.
    """
    size = np.array([len(x) for x in sets])
    row = np.repeat(np.arange(len(sets)), size)
    _, code, count = np.unique(np.concatenate(sets) if len(sets) else np.empty(0, np.uint64), return_inverse=True, return_counts=True)
    common = count[code] > 1
    row, code = row[common], np.unique(code[common], return_inverse=True)[1]
    same = np.zeros((len(sets), len(sets)), dtype=np.float32)
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    for low in range(0, int(code.max(initial=-1)) + 1, 2048):
        a, b = np.searchsorted(code, [low, low + 2048])
        m = np.zeros((len(sets), 2048), dtype=np.float32)
        m[row[a:b], code[a:b] - low] = 1
        same += m @ m.T
    both = same.astype(np.int64)
    either = size[:, None] + size[None, :] - both
    hit = (100 * both >= percent * either) & (label[:, None] < label[None, :])
    hit &= (core[:, None] | core[None, :]) & (part[:, None] != part[None, :])
    i, j = np.nonzero(hit)
    _, of = np.unique(label, return_inverse=True)
    link = np.full((int(of.max(initial=-1)) + 1,) * 2, -1, np.int64)  # a link between two labels, if any
    link[of[i], of[j]] = link[of[j], of[i]] = np.arange(len(i))
    found, new = [], np.ones(len(link), bool)
    for start in range(len(link)):
        reached = [start] if new[start] else []
        new[start] = False
        for x in reached:
            near = np.flatnonzero((link[x] >= 0) & new)
            new[near] = False
            reached += near.tolist()
            found += link[x][near].tolist()
    return [(int(i[k]), int(j[k])) for k in found]


def _columns(t: pa.Table, *names: str) -> list[np.ndarray]:
    return [t[c].to_numpy() if c != "core" else t[c].to_numpy().astype(bool) for c in names]


def _possible(percent: int) -> Callable:
    def rows(t: pa.Table) -> pa.RecordBatch:
        n, label, core, part = _columns(t, "n", "label", "core", "part")
        keep = unit_possible(n, [_bits(v) for v in t["sketch"]], label, core, part, percent)
        left = t.select(["unit", "name", "label", "core", "part"]).filter(pa.array(keep)).combine_chunks()
        return pa.RecordBatch.from_arrays([c.chunk(0) if c.num_chunks else pa.array([], c.type) for c in left.columns], left.column_names)

    return _by_unit(rows)


def _joined(percent: int) -> Callable:
    def pairs(t: pa.Table) -> pa.RecordBatch:
        name, label, core, part = _columns(t, "name", "label", "core", "part")
        found = unit_links([_bits(v) for v in t["shingles"]], label, core, part, percent)
        a, b = (pa.array([int(name[p[k]]) for p in found], pa.int64()) for k in (0, 1))
        return pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return _by_unit(pairs)


def regions(df: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(pivot, name): the documents' sets in the region of each pivot, without the pivot's own.

    Least sets are aggregated before they are shuffled, and the join that hands them
    out has its key on both sides, so a slot that very many sets show is split.
    """
    known = df.sparkSession.sparkContext.broadcast(common)
    shown = df.select("text").mapInArrow(returning_memory(_signed(words, percent, known)), "key long, name long")
    pivots = shown.groupBy("key").agg(F.min("name").alias("pivot"), F.max("name").alias("last")).where("pivot <> last")
    return shown.join(pivots.select("key", "pivot"), "key").where("name <> pivot").select("pivot", "name").distinct()


def _packed_sets(df: DataFrame, known: DataFrame, names: DataFrame, words: int) -> DataFrame:
    """(name, shingles) of the sets ``names``; ``known`` (name, doc_id) says where they are."""
    place = cut(known.join(names.distinct(), "name").select("doc_id", "name"))
    texts = join_small(df.select("doc_id", "text"), place, ["doc_id"]).select("text", "name")
    return cut(texts.mapInArrow(returning_memory(_packed(words)), "name long, shingles binary").dropDuplicates(["name"]))


def pivot_links(df: DataFrame, met: DataFrame, known: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b): the pivots and documents of ``met`` (pivot, name) that are linked.

    Regions are dealt into units of about LEAF documents, and each unit is sent its
    pivot's set once.
    """
    bits = known.select("name", "n", "sketch")
    center = known.select(F.col("name").alias("pivot"), F.col("n").alias("center_n"), F.col("sketch").alias("center"))
    near = met.join(known.select("name", "n"), "name").join(center.drop("center"), "pivot")
    near = near.where(percent * F.greatest("n", "center_n") <= 100 * F.least("n", "center_n")).select("pivot", "name")
    close = cut(near.join(bits, "name").join(center, "pivot").mapInArrow(returning_memory(_close(percent)), "pivot long, name long"))
    packed = _packed_sets(df, known, close.select("name").unionByName(close.select(F.col("pivot").alias("name"))), words)
    sizes = cut(close.groupBy("pivot").agg(F.ceil(F.count("*") / LEAF).cast("int").alias("units")).select((-F.col("pivot")).alias("key"), "units"))
    dealt = join_small(close.withColumn("key", -F.col("pivot")), sizes, ["key"]).select(
        "pivot", "name", F.pmod(F.xxhash64("name"), F.col("units")).cast("int").alias("part")
    )
    own = sizes.select((-F.col("key")).alias("pivot"), (-F.col("key")).alias("name"), F.explode(F.sequence(F.lit(0), F.col("units") - 1)).alias("part"))
    units = dealt.unionByName(own).join(packed, "name").withColumn("unit", F.xxhash64("pivot", "part"))
    units = units.repartition("unit").sortWithinPartitions("unit").select("unit", "pivot", "name", "shingles")
    return cut(units.mapInArrow(returning_memory(_measured(percent)), "a long, b long").distinct())


MEMBER = ["region", "name", "label", "n", "sketch", "core"]
UNIT = ["unit", *MEMBER[1:], "part"]


def _with_sizes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of regions that are not all connected, with the figures of their region; and these figures."""
    figures = members.groupBy("region").agg(
        F.count("*").alias("size"), F.sum("n").alias("weight"), F.max("was").alias("before"), F.min("label").alias("low"),
        F.max("label").alias("high"), F.max("core").alias("lived"), F.max("n").alias("most"),
        (F.min(F.octet_length("sketch")) / 8).cast("long").alias("width"), F.min(F.struct(F.xxhash64("name"), "name"))["name"].alias("first"),
    ).where("low <> high and lived").drop("low", "high", "lived")
    figures = stored(figures.withColumn("key", F.hash("region")))
    return join_small(members.withColumn("key", F.hash("region")), figures, ["key", "region"]), figures


def _blocks(rows: DataFrame) -> DataFrame:
    """Units of regions that pivots do not divide: blocks of bounded size, each against each."""
    blocks = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / WEIGHT)).cast("int")
    dealt = rows.withColumns({"of": blocks, "block": F.pmod(F.xxhash64("name"), blocks).cast("int")})
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    part = F.when(F.col("block") == F.col("with"), F.col("name")).otherwise(F.col("block").cast("long"))
    unit = F.xxhash64("region", F.least("block", "with"), F.greatest("block", "with"))
    return dealt.withColumns({"unit": unit, "part": part}).select(*UNIT)


def _units(members: DataFrame, percent: int) -> DataFrame:
    """(unit, name, label, n, sketch, core, part): pieces of the regions of ``members`` that are compared as they are.

    Two linked documents of a region, of different labels, are in a unit together,
    in different parts and at least one of them at home.
    """
    leaf = lambda rows: rows.where(F.col("size") <= LEAF).withColumns({"unit": F.col("region"), "part": F.col("name")}).select(*UNIT)
    rows, figures = _with_sizes(members.withColumns({"core": F.lit(True), "was": F.lit(None).cast("long")}))
    out = leaf(rows)
    if figures.where(F.col("size") > LEAF).isEmpty():
        return out
    # bands of size: the sizes of linked sets are within a factor of 100 / percent
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9)
    rows = rows.where(F.col("size") > LEAF).withColumn("band", F.explode(F.array(band, band + 1)))
    rows = rows.withColumns({"region": F.xxhash64("region", "band"), "core": F.col("band") == band}).select(*MEMBER, "was")
    while True:
        rows, figures = _with_sizes(stored(rows))
        whole = F.col("before").isNotNull() & (F.col("size") > DIVIDED * F.col("before"))
        large = rows.where(F.col("size") > LEAF)
        out = out.unionByName(leaf(rows)).unionByName(_blocks(large.where(whole)))
        if figures.where((F.col("size") > LEAF) & ~whole).isEmpty():
            return out
        large = large.where(~whole)
        drawn = (F.pmod(F.xxhash64(F.lit(7), "region", "name"), F.col("size")) < PIVOTS) | (F.col("name") == F.col("first"))
        centers = large.where(drawn).groupBy("region").agg(F.collect_list("sketch").alias("centers"))
        large = large.select(*MEMBER, "size", "weight", "most", "width").join(centers, "region")
        ddl = "region long, name long, label long, n long, sketch binary, core boolean, size long, weight long, most long, width long"
        placed = stored(large.mapInArrow(returning_memory(_windows(percent)), f"{ddl}, near array<int>, home int"))
        spread = stored(placed.groupBy("region").agg((F.avg(F.size("near")) <= WINDOWS).alias("divides")).withColumn("key", F.hash("region")))
        placed = join_small(placed.withColumn("key", F.hash("region")), spread, ["key", "region"])
        out = out.unionByName(_blocks(placed.where("not divides")))
        rows = placed.where("divides").withColumn("piece", F.explode("near")).withColumns(
            {"region": F.xxhash64("region", "piece"), "core": F.col("core") & (F.col("piece") == F.col("home")), "was": F.col("size")}
        ).select(*MEMBER, "was")


def links(df: DataFrame, summary: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(a, b): links that connect the set names of ``summary`` (doc_id, name, n, sketch) as all links do.

    Sets travel only where sketches allow a link.
    """
    met = cut(regions(df, common, words, percent))
    names = met.select("name").unionByName(met.select(F.col("pivot").alias("name"))).distinct()
    known = cut(
        summary.join(names, "name").groupBy("name").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    )
    first = pivot_links(df, met, known, words, percent)
    labels = components(first).select(F.col("node").alias("name"), "label")
    labelled = cut(known.join(labels, "name", "left").withColumn("label", F.coalesce("label", "name")).select("name", "label", "n", "sketch"))
    members = met.unionByName(met.select("pivot", F.col("pivot").alias("name")).distinct()).withColumnRenamed("pivot", "region")
    tags = labelled.select("name", "label")
    # regions whose documents are all connected are done
    open_ = members.join(tags, "name").groupBy("region").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    members = members.join(open_.where("low <> high").select("region"), "region").join(labelled, "name")
    units = _units(cut(members.select("region", "name", "label", "n", "sketch")), percent)
    units = cut(
        units.repartition("unit").sortWithinPartitions("unit")
        .mapInArrow(returning_memory(_possible(percent)), "unit long, name long, label long, core boolean, part long")
    )
    packed = _packed_sets(df, known, units.select("name"), words)
    units = units.join(packed, "name").repartition("unit").sortWithinPartitions("unit")
    return first.unionByName(units.mapInArrow(returning_memory(_joined(percent)), "a long, b long").distinct())


def _grouped(df: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, label) of rows whose set takes part, and (doc_id, mark, n) of the others."""
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = docs.withColumn("mark", F.xxhash64("text"))
    found = cut(marked.mapInArrow(returning_memory(_summaries(words, percent)), SUMMARY_DDL))
    common, summary = common_slots(found), found.where("name is not null")
    whole = summary.where("doc_id is not null and n > 0")
    found = components(links(docs.where("doc_id is not null"), whole, common, words, percent))
    found = found.select((-F.col("node")).alias("key"), "label")
    grouped = whole.withColumn("key", -F.col("name")).join(found, "key", "left").select("doc_id", "mark", "n", F.coalesce("label", "name").alias("label"))
    return cut(grouped), summary.where("doc_id is null or n = 0").select("doc_id", "mark", "n")


def near_components(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of sets with a Jaccard similarity of ``percent`` % or more."""
    grouped, alone = _grouped(df, words, percent)
    least = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id")).select((-F.col("label")).alias("key"), "component_id")
    out = grouped.withColumn("key", -F.col("label")).join(least, "key").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(alone.select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def leave_one(df: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component one row stays, of its least doc_id.

    Of rows that share this doc_id with different texts, the one of the least hash of
    its text stays, and of rows that repeat both, the first by their other columns'
    values. Rows without doc_id or words stay; other texts under a doc_id that goes are
    judged by their own component; all columns are kept.
    """
    grouped, _ = _grouped(df, words, percent)
    rows = grouped.groupBy("label", "doc_id", "mark").agg(F.count("*").alias("copies"))
    least = rows.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("stays")).withColumn("key", -F.col("label")).drop("label")
    rows = rows.withColumn("key", -F.col("label")).join(least, "key").withColumn(
        "gone", (F.col("doc_id") != F.col("stays.doc_id")) | (F.col("mark") != F.col("stays.mark"))
    )
    touched = cut(rows.where("gone or copies > 1").select(F.col("doc_id").alias("__d"), F.col("mark").alias("__m"), F.col("gone").alias("__gone")))
    marked = df.withColumns({"__d": F.col("doc_id").cast("long"), "__m": F.xxhash64(F.col("text").cast("string"))})
    marked = join_small(marked, touched, ["__d", "__m"], "left")
    out = marked.where("__gone is null").select(*df.columns)
    if touched.where("not __gone").isEmpty():
        return out
    every = F.struct(*[F.col(c) for c in df.columns])
    one = marked.where("not __gone").groupBy("__d", "__m").agg(F.min_by(every, F.to_json(every)).alias("__row"))
    return out.unionByName(one.select("__row.*"))

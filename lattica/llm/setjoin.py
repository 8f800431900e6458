"""N-gram Jaccard join: exact set-similarity join with set-relation skipping.

A document's set holds the hashes of its distinct k-word shingles. Equal sets
collapse to one entry. Entries are ordered by shingle rarity and indexed by
their prefixes (two sets that reach the threshold share a prefix shingle), so
each index list holds the sets of one shingle, ascending by size, with the
shingle's position in each.

Two relations between sets save work. *Index level*: within a list, blocks of
entries are passed over that are too small to reach the threshold, or whose
shingle stands too far on: a shared shingle leaves room for the rest of the
smaller remainder only, and no more can be shared before it than the lesser
position says. *Component level*: in a first round
every set is checked against the one earlier set it shares most lists with;
where that holds, the two share one component. Links inside a component are
neither derived from those of a similar set nor returned. In middle rounds each set meets a bounded choice of
its lists' sets with other answers, and in the last one all that have another
answer still. Thousands of near copies thus cost a few checks each, and every
link between different components is still tried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import BYTE_VALUES_LOWER, chunks, components, distinct, merged, mix, shingles, signed, span_hashes, utf8, word_spans, written

SETS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text_hash", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("sid", T.LongType()), *[T.StructField(f"mark{q}", T.LongType()) for q in range(4)]])
COUNTS = T.StructType([T.StructField("shingle", T.LongType()), T.StructField("n", T.LongType())])
ENTRIES = T.StructType([T.StructField("token", T.LongType()), T.StructField("sid", T.LongType()), T.StructField("n", T.IntegerType()), T.StructField("pos", T.IntegerType())])
LISTS = T.StructType([*ENTRIES.fields, T.StructField("hub", T.LongType()), T.StructField("hub_n", T.IntegerType())])
PAIRS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("na", T.IntegerType()), T.StructField("nb", T.IntegerType()), T.StructField("ok", T.IntegerType())])
MEMBERS = T.StructType([T.StructField("sid", T.LongType()), T.StructField("members", T.BinaryType())])
LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("common", T.LongType())])


#: Partners in a list that a set meets in each of the middle rounds, and how many of these there are.
HUBS, MIDDLE = 16, 2
#: Rows up to which a side is sent to all executors.
SMALL = 100_000


def document_sets(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Row ranges, their distinct shingle hashes with row offsets, and the set's own hash (0 if empty)."""
    data, off = utf8(column)
    for i, j in chunks(off):
        part, rows = data[off[i] : off[j]], off[i : j + 1] - off[i]
        starts, ends, word_off = word_spans(part, rows)
        hashes, set_off = distinct(*shingles(span_hashes(part, starts, ends, BYTE_VALUES_LOWER), word_off, k))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes), dtype=np.uint64)))
        n = np.diff(set_off)
        sid = np.where(n > 0, mix(total[set_off[1:]] - total[set_off[:-1]] + n.astype(np.uint64)), np.uint64(0))
        yield i, j, hashes, set_off, sid


def parity_marks(hashes: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Four times 64 marks of each set: the parity of its shingles at each place. Sets differ at no more places than in shingles."""
    full = np.flatnonzero(np.diff(off))
    one = np.uint64(1) << (hashes & np.uint64(63))
    out = []
    for q in range(4):
        marks = np.zeros(len(off) - 1, np.uint64)
        if len(full):
            marks[full] = np.bitwise_xor.reduceat(np.where((hashes >> np.uint64(6)) & np.uint64(3) == q, one, np.uint64(0)), off[full])
        out.append(marks)
    return out


def required(nx, ny, percent: int):
    """Least intersection of sets of these sizes: 100 * |x & y| >= percent * |x | y|."""
    return -(-percent * (nx + ny) // (100 + percent))


def prefix_size(n, percent: int):
    return n - -(-percent * n // 100) + 1


class Order:
    """A total order of shingles: frequent ones last, by their counts, the others by their hashes."""

    def __init__(self, frequent: np.ndarray):
        """``frequent``: hashes by ascending count."""
        rank = np.argsort(frequent, kind="stable")
        self.known, self.rank = frequent[rank], rank.astype(np.uint64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.known >> np.uint64(44)] = True

    def tokens(self, hashes: np.ndarray) -> np.ndarray:
        out = hashes >> np.uint64(1)
        if len(self.known):
            maybe = np.flatnonzero(self.maybe[hashes >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
            sure = self.known[place] == hashes[maybe]
            out[maybe[sure]] = np.uint64(1 << 63) + self.rank[place[sure]]
        return out


def frequent_shingles(docs: DataFrame, k: int, most: int, least: int = 8, hold: int = 1 << 20) -> np.ndarray:
    """The ``most`` shingles with the largest counts, ascending by count.

    Counts cover all documents: each task counts what it reads, in runs of about
    ``hold`` shingles, and passes on those it met twice or more. The order they
    give only has to be one for all documents; the join is exact under any.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, seen = [], 0, set()

        def counted() -> pa.RecordBatch:
            values, n = np.unique(np.concatenate(parts), return_counts=True)
            keep = n > 1
            return pa.RecordBatch.from_arrays([pa.array(signed(values[keep])), pa.array(n[keep])], names=COUNTS.names)

        for batch in batches:
            for _, _, hashes, off, sid in document_sets(batch.column(0), k):
                new = np.array([s not in seen for s in sid.tolist()], bool)
                _, first = np.unique(sid, return_index=True)
                fresh = np.zeros(len(sid), bool)
                fresh[first] = True
                seen.update(sid.tolist())
                parts.append(hashes[np.repeat(new & fresh, np.diff(off))])
                size += len(parts[-1])
                if len(seen) > 1 << 16:
                    seen.clear()
                if size > hold:
                    yield counted()
                    parts, size = [], 0
        if size:
            yield counted()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(run, COUNTS).groupBy("shingle").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    rows = counts.orderBy(F.col("n").desc(), "shingle").limit(most).toArrow()
    return np.asarray(rows.column("shingle").to_numpy(), np.int64).view(np.uint64)[::-1].copy()


def prefix_entries(docs: DataFrame, k: int, percent: int, order: Order) -> DataFrame:
    """Index entries of the prefixes of all distinct sets (copies met by other tasks repeat theirs)."""
    sent = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = sent.value, set()
        for batch in batches:
            for _, _, hashes, off, sid in document_sets(batch.column(0), k):
                new = np.zeros(len(sid), bool)
                for r, s in enumerate(sid.tolist()):
                    if s and s not in seen:
                        seen.add(s)
                        new[r] = True
                if len(seen) > 1 << 16:
                    seen.clear()
                if not new.any():
                    continue
                n = np.diff(off)[new]
                row = np.repeat(np.arange(len(n)), n)
                tokens = order.tokens(hashes[np.repeat(new, np.diff(off))])
                tokens = tokens[np.lexsort((tokens, row))]
                start = np.cumsum(n) - n
                pos = np.arange(len(tokens)) - start[row]
                keep = pos < prefix_size(n, percent)[row]
                row, pos = row[keep], pos[keep]
                yield pa.RecordBatch.from_arrays([pa.array(signed(tokens[keep])), pa.array(signed(sid[new][row])), pa.array(n[row].astype(np.int32)), pa.array(pos.astype(np.int32))], names=ENTRIES.names)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, ENTRIES)


def shared_lists(entries: DataFrame) -> DataFrame:
    """The lists of at least two sets, each entry with its list's first set (the hub)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token0 = sid0 = None
        hub: tuple | None = None  # token, sid, n, pos of the open list's first entry
        waiting = False  # it has not been passed on
        for batch in batches:
            token, sid, n, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            if not len(token):
                continue
            fresh = np.ones(len(token), bool)
            fresh[1:] = (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])
            fresh[0] = token[0] != token0 or sid[0] != sid0
            token0, sid0 = token[-1], sid[-1]
            token, sid, n, pos = token[fresh], sid[fresh], n[fresh], pos[fresh]
            if not len(token):
                continue
            begins = np.ones(len(token), bool)
            begins[1:] = token[1:] != token[:-1]
            goes_on = hub is not None and token[0] == hub[0]
            begins[0] = not goes_on
            if goes_on and waiting:  # the hub itself goes before its followers
                token, sid, n, pos = (np.concatenate(([h], x)) for h, x in zip(hub, (token, sid, n, pos)))
                begins = np.concatenate(([True], begins))
                goes_on = False
            starts = np.flatnonzero(begins)
            group = np.cumsum(begins) - 1
            size = np.diff(np.append(starts, len(token)))
            hub_sid, hub_n = np.append(sid[starts], hub[1] if goes_on else 0), np.append(n[starts], hub[2] if goes_on else 0)
            keep = np.append(size, 2)[group] > 1  # entries before the first start (-1) go on with an open list
            if len(starts):
                last = starts[-1]
                hub = (token[last], sid[last], n[last], pos[last])
                waiting = size[-1] == 1
            else:
                waiting = False
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x[keep]) for x in (token, sid)] + [pa.array(x[keep].astype(np.int32)) for x in (n, pos)] + [pa.array(hub_sid[group][keep]), pa.array(hub_n[group][keep].astype(np.int32))],
                    names=LISTS.names,
                )

    return entries.repartition("token").sortWithinPartitions("token", "n", "sid").mapInArrow(run, LISTS)


def hub_pairs(lists: DataFrame, percent: int) -> DataFrame:
    """For each set the one hub it shares most lists with, if those are a fair part of its prefix."""
    near = lists.filter((F.col("sid") != F.col("hub")) & (100 * F.col("hub_n") >= percent * F.col("n")))
    counted = near.groupBy("sid", "hub").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
    fair = counted.filter(4 * F.col("c") >= F.col("n") - F.ceil(F.col("n") * (percent / 100)) + 1)
    return fair.groupBy("sid").agg(F.max_by("hub", F.struct("c", "hub")).alias("hub")).select(F.col("sid").alias("a"), F.col("hub").alias("b"))


def cross_pairs(lists: DataFrame, labels: DataFrame, marks: DataFrame, percent: int, hubs: int = 0, seed: int = 0, block: int = 512) -> DataFrame:
    """Candidate pairs (a, b) of sets that share a list, may reach the threshold, and have no common answer yet.

    With ``hubs`` only lists of more sets than that count, and of them only
    pairs with so many of the list's sets, by a hash with ``seed``: a random
    choice, and the same one in all lists of a group. ``marks`` (sid, mark0 ...
    mark3) bound the intersection of two sets from above.
    """
    label = F.coalesce("component", "sid").alias("label")
    known = lists.select("token", "sid", "n", "pos").join(labels.withColumnRenamed("node", "own"), F.col("sid") == F.col("own"), "left").select("token", "sid", "n", "pos", label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_token, open_rows = None, []  # the open list's entries, by block, none too small for what follows

        def pairs(x: tuple, y: tuple, same: bool) -> pa.RecordBatch | None:
            """x: later entries, y: earlier or the same ones (sid, n, pos, label, marks)."""
            rooms, places = [z[1] - z[2] for z in (x, y)], [z[2] for z in (x, y)]
            least = required(int(x[1].min()), int(y[1].min()), percent)
            if not hubs and (100 * int(y[1].max()) < percent * int(x[1].min()) or min(int(r.max()) for r in rooms) + min(int(p.max()) for p in places) < least):
                return None
            need = required(x[1][:, None], y[1][None], percent)
            room = np.minimum(rooms[0][:, None], rooms[1][None])
            # of a pair that reaches the threshold at most as many shingles are shared before this one as the lesser position says
            ok = (x[3][:, None] != y[3][None]) & (room + np.minimum(places[0][:, None], places[1][None]) >= need)
            differ = sum(np.bitwise_count(a[:, None] ^ b[None]).astype(np.int64) for a, b in zip(x[4:], y[4:]))
            ok &= x[1][:, None] + y[1][None] - differ >= 2 * need
            if same:
                ok &= np.tri(len(x[0]), k=-1, dtype=bool)
            i, j = np.nonzero(ok)
            if not len(i):
                return None
            a, b = x[0][i], y[0][j]
            swap = a > b
            na, nb = x[1][i], y[1][j]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b)), pa.array(np.where(swap, nb, na).astype(np.int32)), pa.array(np.where(swap, na, nb).astype(np.int32)), pa.array((room[i, j] >= need[i, j]).astype(np.int32))],
                names=PAIRS.names,
            )

        for batch in batches:
            token, sid, n, pos, label, *mark = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(9))
            n, pos, mark = n.astype(np.int64), pos.astype(np.int64), [m.view(np.uint64) for m in mark]  # a count of bits takes no sign
            cuts = np.flatnonzero(np.diff(token)) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(token))):
                if lo == hi:
                    continue
                if token[lo] != open_token:
                    open_token, open_rows = token[lo], []
                for a in range(lo, hi, block):
                    x = tuple(c[a : min(hi, a + block)] for c in (sid, n, pos, label, *mark))
                    if hubs:
                        # the list's first sets stay open, all others meet them only
                        room = hubs - sum(len(y[0]) for y in open_rows)
                        if room > 0:
                            open_rows.append(tuple(c[:room] for c in x))
                        for y in open_rows:
                            if (out := pairs(x, y, False)) is not None:
                                yield out
                        continue
                    if (out := pairs(x, x, True)) is not None:
                        yield out
                    open_rows = [y for y in open_rows if 100 * int(y[1].max()) >= percent * int(x[1].min())]
                    for y in open_rows:
                        if (out := pairs(x, y, False)) is not None:
                            yield out
                    open_rows.append(x)

    # lists whose sets all have one answer end here
    several = known.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("sets")).filter((F.col("lo") != F.col("hi")) & (F.col("sets") > hubs)).select("token")
    order = [F.xxhash64("sid", F.lit(seed))] if hubs else ["n", "pos", "sid"]
    left = known.join(several, "token", "left_semi").join(marks, "sid").select("token", "sid", "n", "pos", "label", *[f"mark{q}" for q in range(4)]).repartition("token").sortWithinPartitions("token", *order)
    found = left.mapInArrow(run, PAIRS).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("ok").alias("ok"), F.count(F.lit(1)).alias("c"))
    # shared prefix shingles and all others of the larger rest bound the intersection
    rest = F.greatest(F.ceil(F.col("na") * (percent / 100)), F.ceil(F.col("nb") * (percent / 100))) - 1
    need = F.ceil((F.col("na") + F.col("nb")) * percent / (100 + percent) - 1e-6)
    return found.filter((F.col("ok") > 0) & (F.col("c") + rest >= need)).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame, sets: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of set ids whose sets reach the threshold, by their exact intersection."""
    wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    spot = sets.groupBy("sid").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).join(wanted, "sid", "left_semi").select(F.col("at.doc_id").alias("at_id"), F.col("at.text_hash").alias("at_hash"))
    spot = written(spot, "spots")
    if spot.limit(SMALL + 1).count() <= SMALL:
        spot = F.broadcast(spot)  # at most SMALL rows of 16 bytes; beyond that the texts are shuffled to them
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = source.join(spot, (F.col("text_hash") == F.col("at_hash")) & F.col("doc_id").eqNullSafe(F.col("at_id"))).select("text")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, hashes, off, sid in document_sets(batch.column(0), k):
                raw = hashes.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(signed(sid)), pa.array([raw[8 * x : 8 * y] for x, y in zip(off[:-1], off[1:])], pa.binary())], names=MEMBERS.names)

    found = texts.mapInArrow(members, MEMBERS).dropDuplicates(["sid"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            common = np.zeros(len(a), np.int64)
            keep = np.zeros(len(a), bool)
            for r, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                common[r] = np.count_nonzero(both[1:] == both[:-1])
                keep[r] = 100 * common[r] >= percent * (len(both) - common[r])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(common[keep])], names=LINKS.names)

    x = found.select(F.col("sid").alias("a"), F.col("members").alias("x"))
    y = found.select(F.col("sid").alias("b"), F.col("members").alias("y"))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(check, LINKS)


RESULT = ("doc_id", "n_shingles", "component_id")


def join(docs: DataFrame, k: int = 4, percent: int = 85, frequent: int = 1 << 18, salts: int = 8, detail: bool = False) -> DataFrame:
    """Components of documents whose shingle sets link: (doc_id, n_shingles, component_id).

    With ``detail`` also text_hash (xxhash64 of the text) and label, which tells
    components apart even where rows of several share a doc_id (null for a text
    without shingles).

    Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a
    set holds the distinct ``k``-word shingles of the whole text, or its whole
    sequence if it has fewer words. Two documents link when 100 * |x & y| >=
    ``percent`` * |x | y|. ``component_id`` is the smallest doc_id reachable by
    links. A null, empty or word-less text has no shingle, links with nothing
    and is its own component. Repeated rows repeat in the result; a null doc_id
    is never a component's smallest while another exists; other columns are
    ignored.

    Shingles are 64-bit hashes. ``frequent`` bounds the table of frequent
    shingles that goes to every executor.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, off, sid in document_sets(batch.column(2), k):
                marks = [pa.array(signed(m)) for m in parity_marks(hashes, off)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(off)), pa.array(signed(sid)), *marks], names=SETS.names)

    sets = written(docs.select(F.col("doc_id").cast("long"), F.xxhash64(text), text.alias("text")).mapInArrow(run, SETS), "sets")
    labels = answers(docs, sets.filter("n_shingles > 0"), k, percent, frequent)
    least = sets.filter("n_shingles > 0").groupBy("sid").agg(F.min("doc_id").alias("least"))
    named = least.join(labels, least.sid == labels.node, "left").select("sid", "least", F.coalesce("component", "sid").alias("label"))
    over = named.groupBy("label").agg(F.min("least").alias("component_id"))
    of_set = named.join(over, "label").select("sid", "component_id", "label")
    salted = of_set.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    rows = sets.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    some = rows.filter("n_shingles > 0").join(salted, ["sid", "salt"], "left")
    none = rows.filter("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "label": F.lit(None).cast("long")})
    shown = [*RESULT, "text_hash", "label"] if detail else RESULT
    return some.select(*shown).unionByName(none.select(*shown))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near duplicates: one row of each component (see :func:`join`), and all without words.

    The smallest doc_id of a component stays, of rows that share it the one with
    the smallest text hash; a null doc_id stays only where its component has no
    other. A row repeated whole stays once. All columns are kept.
    """
    found = join(docs, detail=True, **options)
    best = found.filter("label is not null").groupBy("label").agg(F.min_by(F.struct("doc_id", "text_hash"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("k")).select("k.*")
    ids = best.unionByName(found.filter("label is null").select("doc_id", "text_hash").distinct())
    ids = written(ids.select(F.col("doc_id").alias("_kept_id"), F.col("text_hash").alias("_kept_hash")), "kept")
    hashed = docs.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_kept_id")) & (F.col("_text_hash") == F.col("_kept_hash"))
    kept = hashed.join(ids, same, "left_semi")
    repeats = found.join(ids, found.doc_id.eqNullSafe(F.col("_kept_id")) & (found.text_hash == F.col("_kept_hash")), "left_semi").groupBy("doc_id", "text_hash").count().filter("count > 1")
    if repeats.limit(1).count():
        kept = kept.dropDuplicates(["doc_id", "_text_hash"])
    return kept.drop("_text_hash")


def answers(docs: DataFrame, sets: DataFrame, k: int, percent: int, frequent: int) -> DataFrame:
    """(node, component) of all linked sets, by set id."""
    order = Order(frequent_shingles(docs, k, frequent))
    lists = written(shared_lists(prefix_entries(docs, k, percent, order)), "lists")
    marks = sets.groupBy("sid").agg(*[F.max(f"mark{q}").alias(f"mark{q}") for q in range(4)])  # the same for all copies
    check = lambda pairs: written(verify(pairs, docs, sets, k, percent), "links").select("a", "b")
    labels = components(check(written(hub_pairs(lists, percent), "candidates")))
    for seed in range(MIDDLE):
        partners = written(cross_pairs(lists, labels, marks, percent, HUBS, seed), "candidates")
        if not partners.limit(1).count():
            break
        labels = merged(labels, check(partners))
    return merged(labels, check(written(cross_pairs(lists, labels, marks, percent), "candidates")))

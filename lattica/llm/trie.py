"""Conversation prefix trie, by partition refinement.

All conversations start in one class, that of the root. Each round splits the
classes by the next turn; a class is named by the smallest conversation in it,
so a node of the trie is a class and a depth. A class of one sequence is
retired as soon as it appears: the rest of its sequence is a chain without
branches and is emitted straight from its turns. Totals of subtrees are folded
back from the sequences that end or retire below: one grouping of the rows that
the rounds made, since every sequence has a row in each class it went through.

Equal conversations are one sequence with a weight, so a large group of copies
is one row a round. The first two rounds take one turn, each later one twice as
many as the last (at most ``MOST_TURNS``): n shared turns cost log(n) rounds up
to that width.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import removed, written

#: Most turns by which one round splits; conv_ids in a piece of a list of members; parts of a large class.
MOST_TURNS, PIECE, SALTS = 64, 4096, 8
NO_MEMBERS = hashlib.sha256(b"").hexdigest()
KEY = ("n_turns", "mark", "mark2")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def turns(conversations: DataFrame, texts: bool = False) -> DataFrame:
    """Every turn's place in its conversation, written: (conv_id, pos, key, n_chars, chars), with role and text if asked for.

    ``pos`` counts from 1 by ``turn``, nulls first; equal turns of a conversation
    are ordered by ``key``, 16 bytes of the SHA-256 of role and text. ``chars``
    are the code points up to and with the turn. Rows are dealt by ranges of
    (conv_id, turn, key), so one long conversation lies in many tasks; what it
    has in earlier ranges is added from at most one row a range. A null role or
    text is empty; rows without a conv_id belong to no conversation and are left out.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    key = F.unhex(F.substring(F.sha2(name, 256), 1, 32))
    kept = [role.alias("role"), text.alias("text")] if texts else []
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("key"), F.length(text).cast("long").alias("n_chars"), *kept)
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("key")]
    dealt = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).drop("turn")
    schema = T.StructType([*dealt.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("nth", T.LongType()), T.StructField("upto", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, sizes = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            new = np.concatenate(([ids[0] != last], ids[1:] != ids[:-1]))
            start = np.flatnonzero(new) if new[0] else np.concatenate(([0], np.flatnonzero(new)))
            span = np.diff(np.concatenate((start, [len(ids)])))
            sums = np.cumsum(sizes)
            nth, upto = np.arange(1, len(ids) + 1) - np.repeat(start, span), sums - np.repeat(sums[start] - sizes[start], span)
            if not new[0]:
                nth[: span[0]] += n
                upto[: span[0]] += total
            last, n, total = ids[-1], nth[-1], upto[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), part, np.int32)), pa.array(nth), pa.array(upto)], names=schema.names)

    table = written(dealt.mapInArrow(run, schema), "turns")
    pieces = table.groupBy("conv_id", "part").agg(F.max("nth").alias("n"), F.max("upto").alias("c"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as ranges
    later = pieces.select(F.col("conv_id").alias("_conv"), F.col("part").alias("_part"), F.sum("n").over(earlier).alias("_n"), F.sum("c").over(earlier).alias("_c")).filter("_n is not null")
    both = table.join(F.broadcast(later), (F.col("conv_id") == F.col("_conv")) & (F.col("part") == F.col("_part")), "left")  # a conversation continues in a range: at most one row a range
    extra = ["role", "text"] if texts else []
    return both.select("conv_id", (F.col("nth") + F.coalesce("_n", F.lit(0))).alias("pos"), "key", "n_chars", (F.col("upto") + F.coalesce("_c", F.lit(0))).alias("chars"), *extra)


def rebuilt(conversations: DataFrame, block: int = 100, shares: int = 6, texts: bool = False) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of their block's first one: rows like :func:`turns`, and all conv_ids.

    Conversation c gets the first h turns of conversation c - c % ``block`` (all
    if it has fewer, none if it is absent) and then its own turns after its
    first h, with h = CRC-32 of c in decimal, modulo ``shares``. The remainder
    has the sign of c. A base has at most ``block`` users of h turns each. The
    conv_ids include those whose rebuilt conversation has no turn.
    """
    own = turns(conversations, texts)
    h = (F.crc32(F.col("conv_id").cast("string")) % shares).cast("long")
    convs = own.groupBy("conv_id").agg(F.max("pos").alias("n_own")).select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % block).alias("base"))
    convs = written(convs, "conversations")
    extra = ["role", "text"] if texts else []
    first = own.filter(F.col("pos") < shares)
    heads = convs.select("conv_id", "h", "base").join(first.withColumnRenamed("conv_id", "of"), (F.col("base") == F.col("of")) & (F.col("pos") <= F.col("h"))).select("conv_id", "pos", "key", "n_chars", "chars", *extra)
    given = heads.groupBy("conv_id").agg(F.max("pos").alias("n_head"), F.max("chars").alias("head_chars"))
    skipped = first.join(convs.select(F.col("conv_id").alias("of"), "h"), (F.col("conv_id") == F.col("of")) & (F.col("pos") == F.col("h"))).select("conv_id", F.col("chars").alias("own_chars"))
    shift = convs.join(given, "conv_id", "left").join(skipped, "conv_id", "left").select(F.col("conv_id").alias("of"), "h", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_head", "head_chars", "own_chars")])
    tails = own.join(shift, (F.col("conv_id") == F.col("of")) & (F.col("pos") > F.col("h"))).select("conv_id", (F.col("pos") - F.col("h") + F.col("n_head")).alias("pos"), "key", "n_chars", (F.col("chars") - F.col("own_chars") + F.col("head_chars")).alias("chars"), *extra)
    out = written(heads.unionByName(tails), "rebuilt")
    removed(own.sparkSession, own)
    return out, convs.select("conv_id")


def _marks() -> tuple[Column, Column]:
    """Two 64-bit hashes of a turn and its place; those of a sequence are their exclusive ors."""
    return F.xxhash64("pos", "key"), F.xxhash64(F.lit(7), "key", "pos")


def member_hashes(members: DataFrame) -> DataFrame:
    """SHA-256 hex of each sequence's conv_ids in decimal, ascending and joined by commas: (*KEY, ends).

    The ids are sorted by ranges over all sequences and joined in pieces of
    ``PIECE``; one task then hashes the pieces of a sequence as a stream, since
    a hash over all of them has to see them in order.
    """
    order = [*KEY, "conv_id"]
    dealt = members.select(*order).repartitionByRange(_parts(members), *order).sortWithinPartitions(*order)
    pieces = T.StructType([*[T.StructField(c, T.LongType()) for c in (*KEY, "first")], T.StructField("piece", T.StringType())])
    hashes = T.StructType([*[T.StructField(c, T.LongType()) for c in KEY], T.StructField("ends", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not (n := batch.num_rows):
                continue
            columns = [c.to_numpy() for c in batch.columns]
            new = np.arange(n) % PIECE == 0
            for c in columns[:-1]:
                new[1:] |= c[1:] != c[:-1]
            start = np.flatnonzero(new)
            text = columns[-1].astype(str)
            joined = [",".join(text[i:j]) for i, j in zip(start, [*start[1:], n])]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[start]) for c in columns], pa.array(joined)], names=pieces.names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            rows = []
            for *key, _, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if key == now:
                    state.update(b"," + piece.encode())
                    continue
                if state is not None:
                    rows.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(piece.encode())
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(hashes.names, r)) for r in rows])
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(hashes.names, (*now, state.hexdigest())))])

    joined = dealt.mapInArrow(join, pieces)
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digest, hashes)


def _split(paths: DataFrame, active: DataFrame, depth: int, width: int) -> DataFrame:
    """One round: (rep, pos, owner, n_seqs, longest, ...) of the active sequences in the next ``width`` turns, up to where each is alone."""
    a, b = _marks()
    rows = paths.filter((F.col("pos") > depth) & (F.col("pos") <= depth + width)).join(active, "rep").select("rep", "class", "n_turns", "pos", "before", a.alias("a"), b.alias("b"))
    if width > 1:  # hashes of what the sequence has had in this round; at most ``width`` rows each
        so_far = Window.partitionBy("rep").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({"a": F.bit_xor("a").over(so_far), "b": F.bit_xor("b").over(so_far)})
    by = ["class", "pos", "a", "b"]
    classes = rows.groupBy(*by).agg(F.min("rep").alias("owner"), F.count(F.lit(1)).alias("n_seqs"), F.max("n_turns").alias("longest"), F.max("before").alias("before"))
    alone = classes.filter("n_seqs = 1").select(F.col("owner").alias("rep"), "pos", "owner", "n_seqs", "longest", "before")
    salted = rows.withColumn("salt", F.pmod(F.hash("rep"), F.lit(SALTS)))  # a class may hold most sequences
    several = classes.filter("n_seqs > 1").drop("before").withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(SALTS)])))
    shared = salted.join(several, [*by, "salt"]).select("rep", "pos", "owner", "n_seqs", "longest", "before")
    if width > 1:
        alone = alone.groupBy("rep").agg(F.min_by(F.struct("pos", "owner", "n_seqs", "longest", "before"), "pos").alias("x")).select("rep", "x.*")
    return written(shared.unionByName(alone), "classes")


def nodes(rows: DataFrame, convs: DataFrame, texts: bool = False) -> DataFrame:
    """The trie's nodes of ``rows`` (conv_id, pos, key, n_chars, chars) and all ``convs`` (conv_id, one row each).

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256): a node is a distinct sequence of first turns,
    named by the smallest conv_id that begins with it; the root (depth 0, no
    parent) has all. ``saved_tokens`` adds up over the node's subtree, itself
    included, the code points of a node's last turn times its members but one.
    ``ends_sha256`` is over the members that end there. ``texts`` adds role and
    text of the node's last turn. Without conversations there is no node.
    """
    spark = rows.sparkSession
    a, b = _marks()
    marks = rows.withColumns({"a": a, "b": b}).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.bit_xor("a").alias("mark"), F.bit_xor("b").alias("mark2"), F.sum("n_chars").alias("total"))
    members = written(convs.join(marks, "conv_id", "left").select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in (*KEY, "total")]), "members")
    seqs = members.groupBy(*KEY).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.max("total").alias("total"))
    seqs = written(seqs.join(member_hashes(members), list(KEY)).select("rep", "weight", "n_turns", "total", "ends"), "sequences")
    paths = rows.join(seqs.select(F.col("rep").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("rep"), "pos", "key", (F.col("chars") - F.col("n_chars")).alias("before"))
    paths = written(paths, "paths")
    removed(spark, members)

    active = seqs.filter("n_turns > 0").select("rep", F.lit(0).cast("long").alias("class"), "n_turns")
    depth, width, rounds = 0, 1, []
    while not rounds or active.limit(1).count():
        rounds.append(_split(paths, active, depth, width))
        depth, width = depth + width, min(max(1, depth + width), MOST_TURNS)
        active = rounds[-1].filter((F.col("pos") == depth) & (F.col("n_seqs") > 1)).join(seqs.select("rep", "n_turns"), "rep").filter(F.col("n_turns") > depth).select("rep", F.col("owner").alias("class"), "n_turns")

    passed = reduce(DataFrame.unionByName, rounds)
    mine = F.col("owner") == F.col("rep")
    ways = passed.groupBy("rep").agg(
        F.min(F.when(mine, F.col("pos"))).alias("own_from"),
        F.min(F.when(mine, F.col("before"))).alias("own_before"),
        F.max_by(F.when(~mine, F.col("owner")), F.when(~mine, F.col("pos"))).alias("above"),
        F.max(F.when(F.col("n_seqs") == 1, F.col("pos"))).alias("alone_from"),
        F.max_by("longest", "pos").alias("longest"),
    )
    root = seqs.agg(F.min("rep").alias("top"), F.count(F.lit(1)).alias("n_all"))
    known = seqs.join(ways, "rep", "left").crossJoin(F.broadcast(root))  # one row
    leaf = F.when(F.col("n_turns") == 0, F.col("n_all") == 1).otherwise(F.col("alone_from").isNotNull() | (F.col("longest") == F.col("n_turns")))
    known = written(known.select("rep", "weight", "n_turns", "total", "ends", "own_from", "own_before", "alone_from", F.coalesce("above", F.when(F.col("own_from").isNotNull(), F.col("top"))).alias("above"), leaf.cast("long").alias("leaf"), "top"), "known")
    removed(spark, seqs)

    begun = F.col("own_from").isNotNull()
    folded = (
        F.sum("weight").alias("n_convs"),
        F.sum((begun & (F.col("n_turns") > F.col("pos")) & (F.col("own_from") <= F.col("pos") + 1)).cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.col("weight") * (F.col("total") - F.col("before")) - F.when(begun, F.col("total") - F.greatest("before", "own_before")).otherwise(0)).alias("saved_tokens"),
        F.max(F.when(F.col("n_turns") == F.col("pos"), F.col("ends"))).alias("ends"),
        F.max(F.when(F.col("rep") == F.col("owner"), F.when(F.col("pos") == F.col("own_from"), F.col("above")).otherwise(F.col("rep")))).alias("parent"),
    )
    inner = passed.select("rep", "pos", "owner", "before").join(known, "rep").groupBy("owner", "pos").agg(*folded)
    top = known.select("*", F.col("top").alias("owner"), F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("before")).groupBy("owner", "pos").agg(*folded).withColumn("parent", F.lit(None).cast("long"))
    chains = paths.select("rep", "pos", "before").join(known.filter("alone_from is not null"), "rep").filter(F.col("pos") > F.col("alone_from"))
    chains = chains.select(
        F.col("rep").alias("owner"),
        "pos",
        F.col("weight").alias("n_convs"),
        (F.col("pos") < F.col("n_turns")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("weight") - 1) * (F.col("total") - F.col("before"))).alias("saved_tokens"),
        F.when(F.col("pos") == F.col("n_turns"), F.col("ends")).alias("ends"),
        F.col("rep").alias("parent"),
    )
    every = top.unionByName(inner).unionByName(chains)
    out = every.select(F.col("owner").alias("conv_id"), F.col("pos").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(NO_MEMBERS)).alias("ends_sha256"))
    if not texts:
        return out
    return out.join(rows.select("conv_id", F.col("pos").alias("depth"), "role", "text"), ["conv_id", "depth"], "left")


def trie(conversations: DataFrame, block: int = 100, shares: int = 6, texts: bool = False) -> DataFrame:
    """:func:`nodes` of the :func:`rebuilt` conversations (conv_id, turn, role, text); other columns are ignored.

    Null roles and texts are empty, rows without a conv_id are left out, equal
    turns are ordered as :func:`turns` says, an empty table has no node.
    """
    rows, convs = rebuilt(conversations, block, shares, texts)
    out = nodes(rows, convs, texts)
    for table in [convs] if texts else [rows, convs]:
        removed(conversations.sparkSession, table)
    return out

"""Line dedup: an exact set-similarity join of lines, in DataFrame operations only.

A line's tokens are its distinct words, ordered by rarity (counts over all
texts, by hash bucket; the order only has to be the same for all). Lines with
equal sets collapse to the first of them before anything is compared. A prefix
of each set is indexed: two sets that reach the threshold share a prefix token.
Candidates pass a length filter, a positional filter (that of the first token
that a pair shares) and a bound from 128 parity marks of each set; what is left is verified by its exact Jaccard. A line
goes if an earlier line, by (doc_id, line number), is that similar.

Rounds keep large groups of near copies linear: first each set is checked
against the earliest set that shares one of its rarest tokens, then the sets of
long lists that this does not remove against the best of several leads; only
what is left looks for all earlier members of its lists.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import removed, written

#: The hash's upper bits that choose a word's bucket; eight buckets share one number of the table of ranks.
BUCKET_BITS = 16
#: The rank's bits in a token; the hash's upper bits follow.
RANK = 127 << 56
#: Rarest tokens by which a set finds the lists' earliest sets.
HEADS = 2
#: Sets that a list may keep open before it gets several leads, at least and as a part of all sets, how many, and how often it gets others.
LONG, SHARE, LEADS, ROUNDS = 128, 3000, 32, 2
#: Parts of the keys that are joined one after another, which bounds the disk that the index takes.
PARTS = 2
#: Rows up to which a side of a few numbers a row is sent to all executors.
SMALL = 1 << 19
#: Order key of a null doc_id: after all others.
LAST = 2**63 - 1


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _doc_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, line) of every line that is not empty."""
    texts = docs.select(_doc_id().alias("doc_id"), F.xxhash64(_text()).alias("text_hash"), _text().alias("text"))  # below the generator: one hash a text, not a line
    return texts.select("doc_id", "text_hash", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).filter("line <> ''")


def _words(text: Column) -> Column:
    """Lower-case words of a text, and empty strings between them: a split at one character needs no regular expression."""
    blank = F.when(text.rlike(r"[\x09-\x0D]"), F.regexp_replace(text, r"[\x09-\x0D]", " ")).otherwise(text)
    return F.split(F.lower(blank), " ")


def rarity(docs: DataFrame) -> Column:
    """Ranks of the hash buckets by the words they hold over all texts, as one constant array of eight ranks a number.

    A rank is a quarter of an octave of the count, so 7 bits hold any count.
    """
    # explode() would add a filter on the array, and with it a second evaluation of it
    words = docs.select(F.explode_outer(_words(F.replace(_text(), F.lit("\n"), F.lit(" ")))).alias("w")).filter("w <> ''")
    counted = words.groupBy(F.shiftrightunsigned(F.xxhash64("w"), 64 - BUCKET_BITS).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.least(F.floor(4 * F.log2("n")), F.lit(127))
    eight = counted.groupBy(F.shiftright("b", 3).alias("k")).agg(F.bit_or(F.call_function("shiftleft", rank, (8 * (7 - F.col("b").bitwiseAND(F.lit(7)))).cast("int"))).alias("v"))
    packed = [0] * (1 << BUCKET_BITS - 3)
    for k, v in zip(*eight.toArrow().to_pydict().values(), strict=True):  # at most 2**13 rows
        packed[k] = v
    return F.split(F.lit(",".join(map(str, packed))), ",").cast("array<bigint>")


def _token(ranks: Column, h: Column) -> Column:
    """The rank of a word's bucket above the upper 56 bits of its hash."""
    nth = F.shiftrightunsigned(h, 61 - BUCKET_BITS).bitwiseAND(F.lit(56)).cast("int")
    rank = F.call_function("shiftleft", ranks[F.shiftrightunsigned(h, 67 - BUCKET_BITS)], nth).bitwiseAND(F.lit(RANK))
    return rank.bitwiseOR(F.shiftrightunsigned(h, 8))


def _sets(lines: DataFrame) -> DataFrame:
    """``lines`` with ``hashes`` in place of the line: those of its distinct words, none for a line without words.

    A filter on them here would be pushed below and evaluate them a second time.
    """
    hashes = F.array_remove(F.array_distinct(F.transform(_words(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    return lines.withColumn("hashes", hashes).drop("line")


def _least(n: Column, percent: int) -> Column:
    return F.ceil(n * (percent / 100) - 1e-6)


def _parity(half: bool) -> Column:
    """64 marks of a set's tokens, or of those of one half, by bits of the hash: the parity of the tokens at each place."""
    one = lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1)) if half else F.lit(1).cast("long")
    return F.aggregate("keys", F.lit(0).cast("long"), lambda acc, k: acc.bitwiseXOR(F.call_function("shiftleft", one(k), k.bitwiseAND(F.lit(63)).cast("int"))))


def _differ(marks: list[tuple[Column, Column]]) -> Column:
    """Places at which the marks of two sets differ: no more than the tokens that only one of them has."""
    return reduce(lambda x, y: x + y, [F.bit_count(x.bitwiseXOR(y)) for x, y in marks])


def _may_share(shared: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether so many shared tokens are enough for sets of n and m tokens, in whole numbers."""
    return (100 + percent) * shared >= percent * (n + m)


def _may_match(n: Column, m: Column, marks: list[tuple[Column, Column]], percent: int) -> Column:
    """Length filter and parity bound for sets of n and m tokens: 2 |x & y| <= n + m - popcount(xor)."""
    return _may_share(F.least(n, m), n, m, percent) & ((100 + percent) * _differ(marks) <= (100 - percent) * (n + m))


def _sent(table: DataFrame) -> DataFrame:
    """A written table of a few numbers a row, to be sent to all executors if it has at most ``SMALL`` rows."""
    return F.broadcast(table) if table.limit(SMALL + 1).count() <= SMALL else table


def duplicate_lines(docs: DataFrame, percent: int = 80, salts: int = 8) -> DataFrame:
    """(doc_id, text_hash, line_no) of each line to remove (see :func:`dedup` for the rule), as a written table."""
    spark = docs.sparkSession
    ranks = rarity(docs)
    n = F.size("keys")
    hashed = _sets(_lines(docs).withColumn("line_hash", F.xxhash64("line")))
    keyed = hashed.withColumn("keys", F.sort_array(F.transform("hashes", lambda h: _token(ranks, h)))).withColumn("odd", _parity(True)).withColumn("all", _parity(False))
    marked = keyed.select(
        "doc_id", "text_hash", "line_no", "line_hash", F.xxhash64("keys").alias("sid"), n.alias("n"), "odd", F.col("odd").bitwiseXOR(F.col("all")).alias("even"), F.slice("keys", F.lit(1), (n - _least(n, percent) + 1).cast("int")).alias("prefix")
    )
    marks = written(marked, "line-marks")
    place = ["doc_id", "line_no", "text_hash"]
    one = marks.filter("n > 0").groupBy("sid").agg(F.min(F.struct(*place, "line_hash", "n", "odd", "even", "prefix")).alias("f"), F.count(F.lit(1)).alias("copies"))
    firsts = written(one.select("sid", "copies", "f.*"), "line-firsts")
    # of different sets of n and n + 1 tokens or more at most n of n + 1 are shared
    may = firsts.filter(100 * F.col("n") >= percent * (F.col("n") + 1))

    def similar(pairs: DataFrame) -> DataFrame:
        """Of the pairs (late, early) of set ids with the sets' first places the late ones of those that reach the threshold."""
        ends = [pairs.select(F.col(s).alias("sid"), f"{s}_place.*") for s in ("late", "early")]
        wanted = written(ends[0].unionByName(ends[1]).distinct(), "line-places")
        few = wanted.limit(SMALL + 1).count() <= SMALL
        sent = F.broadcast if few else (lambda df: df)  # rows of 40 bytes; beyond SMALL of them the lines are shuffled to them
        texts = sent(wanted.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).distinct())
        source = _lines(docs.join(texts, (_doc_id() == F.col("w_id")) & (F.xxhash64(_text()) == F.col("w_hash")), "left_semi"))
        rows = source.withColumn("line_hash", F.xxhash64("line")).join(sent(wanted), [*place, "line_hash"])
        sets = written(_sets(rows).select("sid", "hashes").dropDuplicates(["sid"]), "line-sets")
        side = lambda name: sets.select(F.col("sid").alias(name), F.col("hashes").alias(f"{name}_hashes"))
        both = pairs.select("late", "early").join(side("late"), "late").join(side("early"), "early")
        shared = F.size(F.array_intersect("late_hashes", "early_hashes"))
        counted = both.select("late", shared.alias("c"), (F.size("late_hashes") + F.size("early_hashes")).alias("s"))
        out = written(counted.filter(100 * F.col("c") >= percent * (F.col("s") - F.col("c"))).select("late").distinct(), "line-gone")
        for done in (wanted, sets):
            removed(spark, done)
        return out

    # round 1: the earliest set of the lists of a set's rarest tokens
    here = F.struct(*place, "line_hash")
    heads = may.select(F.explode(F.slice("prefix", 1, HEADS)).alias("key"), here.alias("late_place"), "sid", "n", "odd", "even")
    me = F.struct(F.col("late_place").alias("place"), "sid", "n", "odd", "even")
    pairs_of = [(F.col(b), F.col(f"f.{b}")) for b in ("odd", "even")]

    def led(sets: DataFrame, leads: DataFrame, least: int = 0) -> DataFrame | None:
        """The sets that resemble the lead of a list that differs least by its marks; None if so few have one that it does not pay."""
        met = sets.join(leads, "key").filter((F.col("f.place") < F.col("late_place")) & (F.col("sid") != F.col("f.sid")) & _may_match(F.col("n"), F.col("f.n"), pairs_of, percent))
        best = met.groupBy(F.col("sid").alias("late")).agg(F.max_by(F.struct("late_place", "f"), F.struct(-_differ(pairs_of), "f.sid")).alias("b"))
        chosen = written(best.select("late", "b.late_place", F.col("b.f.sid").alias("early"), F.col("b.f.place").alias("early_place")), "line-pairs")
        out = similar(chosen) if chosen.limit(least + 1).count() > least else None
        removed(spark, chosen)
        return out

    leads = heads.groupBy("key").agg(F.min(me).alias("f"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "f")
    gone = [led(heads, leads, -1)]
    every_gone = lambda: reduce(DataFrame.unionByName, gone)
    # long lists of sets that are left: several leads each, the earliest of each part of the list
    listed = lambda sets: sets.select(F.explode("prefix").alias("key"), here.alias("late_place"), "sid", "n", "odd", "even")
    most = max(LONG, firsts.count() // SHARE)  # a list grows with the table unless a group of near copies is in it
    for seed in range(ROUNDS):
        left = may.join(_sent(every_gone()), F.col("sid") == F.col("late"), "left_anti")
        long = written(left.select(F.explode("prefix").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > most).select("key"), "line-keys")
        more = None
        if long.limit(1).count():
            keys = _sent(long)
            part = F.pmod(F.xxhash64("sid", F.lit(seed)), F.lit(LEADS))
            leads = listed(may).join(keys, "key", "left_semi").groupBy("key", part.alias("part")).agg(F.min(me).alias("f")).select("key", "f")
            more = led(listed(left).join(keys, "key", "left_semi"), leads, most)
        removed(spark, long)
        if more is None:
            break
        gone.append(more)

    # round 2: all sets of the lists of those that are left; n, position and whether a set is left share one number
    left = may.join(_sent(every_gone()), may.sid == F.col("late"), "left").select("sid", "doc_id", "n", "odd", "even", "prefix", F.col("late").isNull().cast("long").alias("open"))
    entries = left.select(F.posexplode("prefix").alias("pos", "key"), "sid", "doc_id", "odd", "even", "n", "open")
    packed = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(F.col("open"))
    size = {s: F.shiftright(f"{s}_at", 32) for s in ("late", "early")}
    pos = {s: F.shiftright(F.col(f"{s}_at").bitwiseAND(F.lit((1 << 32) - 1)), 1) for s in ("late", "early")}
    room = F.least(*[size[s] - pos[s] for s in pos])
    # all that a pair shares stands at the first shared token or after it, so a row of that token is enough
    near = (
        (F.col("late_key") == F.col("early_key"))
        & (F.col("late") != F.col("early"))
        # written so that it stays in the join: both sides then share one exchange
        & ((F.col("late_at").bitwiseAND(F.lit(1)) == 1) | (F.col("late") == F.col("early")))
        & (F.col("early_doc") <= F.col("late_doc"))
        & _may_share(room, size["late"], size["early"], percent)
        & _may_match(size["late"], size["early"], [(F.col(f"late_{b}"), F.col(f"early_{b}")) for b in ("odd", "even")], percent)
    )
    counts = []
    for part in range(PARTS):
        some = entries.filter(F.pmod(F.col("key"), F.lit(PARTS)) == part)
        late, early = (some.select(F.col("key").alias(f"{s}_key"), F.col("sid").alias(s), F.col("doc_id").alias(f"{s}_doc"), packed.alias(f"{s}_at"), F.col("odd").alias(f"{s}_odd"), F.col("even").alias(f"{s}_even")) for s in ("late", "early"))
        counts.append(written(late.join(early, near).select("late", "early").distinct(), "line-counts"))
    found = written(reduce(DataFrame.unionByName, counts).distinct(), "line-pairs")
    ids = written(found.select(F.col("late").alias("sid")).unionByName(found.select(F.col("early").alias("sid"))).distinct(), "line-ids")
    spots = written(firsts.join(_sent(ids), "sid", "left_semi").select("sid", here.alias("spot")), "line-places")
    at = lambda s: spots.select(F.col("sid").alias(s), F.col("spot").alias(f"{s}_place"))
    tried = written(found.join(at("late"), "late").join(at("early"), "early").filter("early_place < late_place").select("late", "late_place", "early", "early_place"), "line-pairs")
    more = similar(tried)

    # a removed set loses all its lines, any other set all but its first
    out = _sent(written(every_gone().unionByName(more).distinct().withColumn("out", F.lit(True)), "line-gone"))
    repeated = firsts.select("sid", *[F.col(c).alias(f"f_{c}") for c in place], "copies").join(out, F.col("sid") == F.col("late"), "left").filter("out or copies > 1").drop("late", "copies")
    spread = repeated.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
    some = marks.select(*place, "sid").withColumn("salt", F.pmod(F.xxhash64("doc_id", "line_no"), F.lit(salts)).cast("int"))
    first = (F.col("doc_id") == F.col("f_doc_id")) & (F.col("line_no") == F.col("f_line_no")) & (F.col("text_hash") == F.col("f_text_hash"))
    gone_lines = written(some.join(spread, ["sid", "salt"]).filter(F.coalesce("out", F.lit(False)) | ~first).select("doc_id", "text_hash", "line_no"), "line-removed")
    for done in (marks, firsts, *counts, found, ids, spots, tried, *gone, more):
        removed(spark, done)
    return gone_lines


def dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` with later similar lines taken out of ``text``; adds n_lines and n_removed.

    Lines are parted by line feeds. Words are runs of characters other than
    0x20 and 0x09-0x0D, in lower case; a line's set holds its distinct words. A
    line is removed if an earlier line, by (doc_id, line number) over the whole
    table, has a Jaccard of at least ``percent`` hundredths; the earlier line
    counts whether or not it is removed itself. A line of any length counts,
    but one without words always stays. The lines left are joined by line feeds
    again, untouched.

    A null text stays null with no line removed, an empty one is one empty
    line; a null doc_id comes after all others. Of rows that share a doc_id the
    lines are ordered by (line number, xxhash64 of the text); a row repeated
    whole loses the lines that its twin loses. All other columns are kept as
    they are; columns named n_lines and n_removed are replaced.
    """
    out = duplicate_lines(docs, percent).groupBy("doc_id", "text_hash").agg(F.collect_set("line_no").alias("_removed"))
    out = out.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_removed")
    kept = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    joined = docs.select(*kept).join(out, (_doc_id() == F.col("_id")) & (F.xxhash64(_text()) == F.col("_hash")), "left")
    lines = F.split(F.col("text").cast("string"), "\n")
    rest = F.when(F.col("_removed").isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(F.col("_removed"), i)), "\n"))
    n_removed = F.when(F.col("_removed").isNull(), 0).otherwise(F.size("_removed"))
    return joined.select(*[rest.alias("text") if c == "text" else F.col(c) for c in kept], F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"), n_removed.cast("long").alias("n_removed"))

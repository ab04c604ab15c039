"""Prefix trie of conversations: Spark SQL's ROLLUP over positional columns of turn ids, in blocks of columns.

A turn becomes two hashes of its place, role and text and the number of its words, so texts never leave the scan.
A conversation is cut into blocks of ``BLOCK`` turns; a block's row holds its turns in columns t1, t2 ... beside
its key: the sums of the hashes (and of the words) of all turns before it, which name the prior block's last
node. ``GROUP BY key, ROLLUP(t1, t2 ...)`` then aggregates all prefixes of all blocks together; ``grouping_id``
tells a group's depth. Hashes depend on the place, so a sum of them names a sequence, and sums over blocks are
added up in two levels: no conversation is ever gathered, however long it is.

Two rollups are enough for sums over subtrees. The first gives each node its smallest member, its owner. If a
conversation owns a node, it owns all below it on its own path; so its owned nodes begin at one depth, with as
many words before it, and what the conversation's turns save is the words before that depth. The second rollup
adds this up over the members of each node, with a one for each conversation that owns a leaf. Counts of a node
whose members are a third of all rows are added up before they are moved.

Defined results: conversations have a turn or more of their own; rows without a conv_id belong to none. Turns of
equal number are put in order of role, then text, by the first ``TOLD`` characters of either, then by hash.
Conversations rebuilt without a turn are members of the root only. An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from logsieve.llm.shared import materialize, table

#: Turns to a block, and blocks whose sums are added up at a time.
BLOCK, STRETCH = 8, 1024
#: Ids to a piece of the list of a node's ends.
PIECE = 20_000
#: Characters of role and of text that order turns of equal number, before their hashes do.
TOLD = 200
_SUM = "decimal(38,0)"


def _words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


# Turns in order --------------------------------------------------------------------------------------


def _running(df: DataFrame, key: str, place: str) -> DataFrame:
    """``df`` with ``place``: the rows of the same ``key`` before each in its partition. Partitions must be sorted by ``key``."""
    at = df.columns.index(key)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, n = None, 0
        for batch in batches:
            places = []
            for k in batch.column(at).to_pylist():
                last, n = k, n + 1 if k == last else 0
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=[*batch.schema.names, place])

    return df.mapInArrow(run, f"{schema}, `{place}` long")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h, g, words) of every turn, ``pos`` from 1 in the conversation's order; h and g are hashes of role and text.

    Turns are dealt by ranges of (conversation, turn, role, text), so one of many turns fills many partitions,
    which count for themselves; what came before a partition is added from counts by partition.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    digests = [F.xxhash64(F.lit(seed), text("role"), text("text")).alias(name) for seed, name in ((1, "h"), (2, "g"))]
    begin = lambda c: F.substring(text(c), 1, TOLD).alias(c)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), begin("role"), begin("text"), *digests, _words(text("text")).alias("words"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "h", "g", "salt")]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("salt", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lean = dealt.select("conv_id", F.spark_partition_id().alias("part"), "h", "g", "words")
    lean = materialize(_running(lean, "conv_id", "within"), "turns")
    counts = lean.groupBy("conv_id", "part").count()
    before = F.coalesce(F.sum("count").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = counts.select("conv_id", "part", before.alias("before")).where("before > 0")  # conversations over more than one partition
    return lean.join(cut, ["conv_id", "part"], "left").select("conv_id", (F.col("within") + 1 + F.coalesce("before", F.lit(0))).alias("pos"), "h", "g", "words")


def rebuilt(turns: DataFrame) -> DataFrame:
    """Turns of :func:`numbered` in rebuilt conversations: the first h of conversation c - c % 20, then the own ones after the first h.

    h is the crc32 of the conversation's id in digits, modulo 4. Conversations left without a turn have one row whose pos is null.
    """
    head = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % 20
    bases = turns.where((F.col("conv_id") % 20 == 0) & (F.col("pos") <= 3)).groupBy(F.col("conv_id").alias("base"))
    bases = bases.agg(F.sort_array(F.collect_list(F.struct("pos", "h", "g", "words"))).alias("heads"))  # three at most
    every = turns.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id", head.alias("take"), first.alias("base"))
    taken = F.coalesce(F.slice("heads", F.lit(1), F.col("take")), F.array().cast("array<struct<pos:bigint,h:bigint,g:bigint,words:bigint>>"))
    every = materialize(every.join(bases, "base", "left").select("conv_id", "take", taken.alias("taken")), "conversations")
    own = turns.join(every.select("conv_id", "take", F.size("taken").alias("lent")), "conv_id").where("pos > take").select("conv_id", (F.col("pos") - F.col("take") + F.col("lent")).alias("pos"), "h", "g", "words")
    lent = every.select("conv_id", F.explode_outer("taken").alias("t")).select("conv_id", "t.pos", "t.h", "t.g", "t.words")
    return own.unionByName(lent)


# Blocks ----------------------------------------------------------------------------------------------


def _turn(n: int) -> str:
    return f"t{n}"


def blocks(turns: DataFrame, width: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """(conv_id, block, key, t1 ... of so many columns) of rebuilt turns; ``key`` holds the sums (a, b, words) of the blocks before.

    Block 0 is there for every conversation, even without turns. Sums are added up over stretches of blocks, then within each.
    """
    place = F.coalesce(F.col("pos") - 1, F.lit(0))
    number = lambda seed: F.xxhash64(F.lit(seed), "pos", "h", "g")
    turn = F.when(F.col("pos").isNotNull(), F.struct(number(3).alias("a"), number(4).alias("b"), F.col("words")))
    cut = turns.select("conv_id", F.floor(place / width).cast("long").alias("block"), (place % width).alias("at"), turn.alias("t"))
    rows = cut.groupBy("conv_id", "block").agg(*[F.max(F.when(F.col("at") == n, F.col("t"))).alias(_turn(n + 1)) for n in range(width)])
    total = lambda f: sum((F.coalesce(F.col(f"{_turn(n + 1)}.{f}"), F.lit(0)).cast(_SUM) for n in range(1, width)), F.coalesce(F.col(f"{_turn(1)}.{f}"), F.lit(0)).cast(_SUM)).cast(_SUM)
    rows = rows.select("*", F.floor(F.col("block") / stretch).alias("stretch"), *[total(f).alias(f"own_{f}") for f in ("a", "b", "words")])
    rows = materialize(rows, "blocks")
    before = lambda name, w: F.coalesce(F.sum(name).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).cast(_SUM)
    far = W.partitionBy("conv_id").orderBy("stretch")
    stretches = rows.groupBy("conv_id", "stretch").agg(*[F.sum(f"own_{f}").cast(_SUM).alias(f"own_{f}") for f in ("a", "b", "words")])
    stretches = stretches.select("conv_id", "stretch", *[before(f"own_{f}", far).alias(f"far_{f}") for f in ("a", "b", "words")])
    near = W.partitionBy("conv_id", "stretch").orderBy("block")
    rows = rows.withColumns({f"near_{f}": before(f"own_{f}", near) for f in ("a", "b", "words")}).join(stretches, ["conv_id", "stretch"])
    key = F.struct(*[(F.col(f"far_{f}") + F.col(f"near_{f}")).cast(_SUM).alias(f) for f in ("a", "b")], (F.col("far_words") + F.col("near_words")).cast("long").alias("words"))
    return rows.select("conv_id", "block", key.alias("key"), *[_turn(n + 1) for n in range(width)])


def _rollup(rows: DataFrame, width: int, aggregates: list[str]) -> DataFrame:
    """A row for each node: depth, its sums (a, b), the words before its last turn and in it, its parent's sums, and the aggregates."""
    columns = ", ".join(_turn(n + 1) for n in range(width))
    grouped = rows.sparkSession.sql(f"SELECT block, key, {columns}, grouping_id() AS gid, {', '.join(aggregates)} FROM {{rows}} GROUP BY block, key, ROLLUP({columns})", rows=rows)
    # The last columns are rolled up: of w columns, d are left where the last w - d bits are set.
    level = sum((F.when(F.col("gid") == (1 << (width - d)) - 1, F.lit(d)).otherwise(0) for d in range(1, width + 1)), F.lit(0))
    real = F.when(F.col("gid") == (1 << width) - 1, F.col("block") == 0)
    for d in range(1, width + 1):
        real = real.when(F.col("gid") == (1 << (width - d)) - 1, F.col(_turn(d)).isNotNull())
    kept = grouped.where(real).withColumn("level", level)
    names = [a.rsplit(" AS ", 1)[1] for a in aggregates]
    turns = F.array(*[F.col(_turn(n + 1)) for n in range(width)])
    last = F.when(F.col("level") > 0, F.element_at(turns, F.col("level")))
    add = lambda f, kind: sum((F.when(F.col("level") > n, F.coalesce(F.col(f"{_turn(n)}.{f}"), F.lit(0))).otherwise(F.lit(0)).cast(kind) for n in range(1, width)), F.col(f"key.{f}")).cast(kind)
    kept = kept.select("*", last.alias("last"), add("a", _SUM).alias("up_a"), add("b", _SUM).alias("up_b"), add("words", "long").alias("words_before"))
    own = lambda f: (F.col(f"up_{f}") + F.coalesce(F.col(f"last.{f}"), F.lit(0)).cast(_SUM)).cast(_SUM)
    return kept.select((F.col("block") * width + F.col("level")).alias("depth"), own("a").alias("a"), own("b").alias("b"), "up_a", "up_b", "words_before", F.coalesce("last.words", F.lit(0)).cast("long").alias("words"), *names)


# Ends ------------------------------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, a, b, first, ids) of sorted (depth, a, b, conv_id): up to ``PIECE`` ids of one node, joined by commas."""
    out: list[tuple] = []

    def close(key: tuple | None, ids: list[int]) -> None:
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))

    def batch_of() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64(), pa.string())
        made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 5, kinds, strict=True)], names=["depth", "a", "b", "first", "ids"])
        out.clear()
        return made

    last, ids = None, []
    for batch in batches:
        for *key, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != last or len(ids) == PIECE:
                close(last, ids)
                last, ids = key, []
            ids.append(conv)
        yield batch_of()
    close(last, ids)
    yield batch_of()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(depth, a, b, sha256) of pieces sorted by node and first id; a digest takes them in one after the other."""
    last, digest = None, None
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key == last:
                digest.update(b"," + ids.encode())
                continue
            if last is not None:
                done.append((*last, digest.hexdigest()))
            last, digest = key, hashlib.sha256(ids.encode())
        if done:
            yield _digest_batch(done)
    if last is not None:
        yield _digest_batch([(*last, digest.hexdigest())])


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["depth", "a", "b", "ends_sha256"])


def _ends(conversations: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of every node at which conversations (conv_id, depth, a, b) end.

    Ids are dealt by ranges of node and id, so a node where many end fills many partitions, each of which joins its ids
    to pieces; only pieces meet at their node, where they pass through the digest one at a time.
    """
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    node = ["depth", "a", "b"]
    ids = conversations.select(*node, "conv_id").repartitionByRange(n, *node, "conv_id").sortWithinPartitions(*node, "conv_id")
    pieces = ids.mapInArrow(_pieces, f"depth long, a {_SUM}, b {_SUM}, first long, ids string")
    return pieces.repartition(n, *node).sortWithinPartitions(*node, "first").mapInArrow(_digests, f"depth long, a {_SUM}, b {_SUM}, ends_sha256 string")


# The trie --------------------------------------------------------------------------------------------


def trie(turns: DataFrame, width: int = BLOCK, stretch: int = STRETCH) -> DataFrame:
    """The nodes of all prefixes of the conversations (conv_id, pos, h, g, words); a null pos stands for no turn.

    A node is named by its smallest member and its depth.
    """
    rows = materialize(blocks(turns, width, stretch), "keyed")
    node = ["depth", "a", "b"]
    nodes = materialize(_rollup(rows, width, ["min(conv_id) AS owner"]), "nodes")

    # Where each owner's nodes begin, and the parent of the first of them.
    begin = F.min(F.struct("depth", "words_before", "up_a", "up_b")).alias("f")
    owners = materialize(nodes.groupBy("owner").agg(begin).select("owner", "f.*"), "owners")
    hung = owners.where("depth > 0").select("owner", (F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"))
    parents = materialize(hung.join(nodes.select(*node, F.col("owner").alias("parent")), node).select("owner", "parent", "depth"), "parents")
    side = parents.groupBy(F.col("parent").alias("owner"), "depth").agg(F.count("*").alias("side"))  # children that others own

    # Length, words and end of each conversation.
    columns = [F.col(_turn(n + 1)) for n in range(width)]
    filled = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    add = lambda f, kind: sum((F.coalesce(c[f], F.lit(0)).cast(kind) for c in columns), F.col(f"key.{f}")).cast(kind)
    whole = rows.select("conv_id", (F.col("block") * width + filled).alias("depth"), add("a", _SUM).alias("a"), add("b", _SUM).alias("b"), add("words", "long").alias("words"))
    whole = whole.groupBy("conv_id").agg(F.max(F.struct("depth", "a", "b", "words")).alias("w")).select("conv_id", "w.*")
    whole = whole.join(owners.select(F.col("owner").alias("conv_id"), F.col("words_before").alias("until")), "conv_id", "left")
    whole = whole.join(side.select(F.col("owner").alias("conv_id"), "depth", "side"), ["conv_id", "depth"], "left")
    leaf = (F.col("until").isNotNull() & F.col("side").isNull()).cast("long")
    whole = materialize(whole.select("conv_id", *node, leaf.alias("leaf"), F.coalesce("until", "words").alias("saved")), "wholes")

    told = rows.join(whole.select("conv_id", "leaf", "saved", F.col("depth").alias("length")), "conv_id")
    sums = ["min(conv_id) AS conv_id", "count(1) AS n_convs", "sum(leaf) AS n_leaves", "sum(saved) AS saved", "min(saved) AS least", "min_by(length, conv_id) AS length"]
    found = _rollup(told, width, sums)
    found = found.join(_ends(whole), node, "left").join(side.withColumnRenamed("owner", "conv_id"), ["conv_id", "depth"], "left")
    found = found.join(parents.select(F.col("owner").alias("conv_id"), (F.col("depth") + 1).alias("depth"), "parent"), ["conv_id", "depth"], "left")
    longer = (F.col("length") > F.col("depth")).cast("long")
    # The owner's own words before this node aren't saved; the other members' all are but those before the node.
    saved = F.col("saved") - F.col("least") - (F.col("n_convs") - 1) * F.col("words_before")
    return found.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "n_convs", (longer + F.coalesce("side", F.lit(0))).alias("n_children"), "n_leaves",
        saved.alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "words",
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all rebuilt ``conversations``."""
    turns = numbered(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    return trie(rebuilt(materialize(turns, "numbered"))).drop("words")

"""The prefix trie of rebuilt conversations, by partition refinement.

A conversation's turns are ordered by turn (null first; ties by a digest of role and text). It is rebuilt from the first
h turns of the conversation that begins its group of five, and its own turns after its first h. Equal conversations are
merged first, so classes hold distinct sequences. All sequences begin in one class, the root. In each round the classes
that hold several are split by the next turn; every part is a node, and a class left with one sequence retires: what
follows of it is a chain of nodes with one child each, made in one join. Counts of leaves and saved tokens are folded
back from the deepest round to the root; for chains they come from sums that the turns carry.

Every step is a join or a grouping of short rows (a digest stands for role and text), each round reads only the turns
of its depth's band. Turns get their places by a sort in ranges whose ends are patched together, so a single
conversation may hold any share of the rows. Ids of equal conversations are joined in blocks of ids; the SHA-256 over
all blocks of one node is a single pass over its ids by its definition, which streams them in order.

Null role and text are ''. Rows without conv_id belong to no conversation and are left out. The first of a group is
c - pmod(c, 5), for negative ids too. Repeated rows are turns of their own. Conversations without turns after rebuilding
are members of the root. An empty table has no nodes. Extra columns are ignored.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.llm.common import cut, written

#: Conversations of a group, and turns that h can take from the group's first at most.
GROUP, MOST = 5, 8
#: Ids whose decimal forms are joined in one row: 2^BLOCK consecutive numbers.
BLOCK = 12
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
NONE = hashlib.sha256(b"").hexdigest()


def shared_turns(conv: Column) -> Column:
    return F.pmod(F.crc32(conv.cast("string")), F.lit(MOST + 1)).cast("int")


def placed(turns: DataFrame) -> DataFrame:
    """conv, pos (from 1), key, bytes, cum (bytes up to the turn) of every turn (conv, turn, key, bytes)."""
    df = cut(turns.repartitionByRange("conv", "turn", "key").sortWithinPartitions("conv", "turn", "key").select("conv", "key", "bytes"))

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """First and last conversation of a partition, with the rows and bytes of the last one there."""
        first = last = None
        rows = size = 0
        for b in batches:
            if b.num_rows:
                conv, n = b.column("conv").to_numpy(), b.column("bytes").to_numpy()
                first = conv[0] if first is None else first
                if conv[-1] != last:
                    rows = size = 0
                at = np.searchsorted(conv, conv[-1])
                last, rows, size = conv[-1], rows + len(conv) - int(at), size + int(n[at:].sum())
        if first is not None:
            yield pa.RecordBatch.from_pylist([{"p": TaskContext.get().partitionId(), "first": int(first), "last": int(last), "n": rows, "size": size}])

    carried, before = {}, None
    for r in sorted(df.mapInArrow(ends, "p long, first long, last long, n long, size long").collect()):
        carry = before[1:] if before and before[0] == r.first else (0, 0)
        carried[r.p] = carry
        own = (r.n + carry[0], r.size + carry[1]) if r.first == r.last else (r.n, r.size)
        before = (r.last, *own)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, (rows, size) = None, carried.get(TaskContext.get().partitionId(), (0, 0))
        for b in batches:
            if not b.num_rows:
                continue
            conv, n = b.column("conv").to_numpy(), b.column("bytes").to_numpy()
            if last is not None and conv[0] != last:
                rows = size = 0
            begins = np.flatnonzero(np.append(True, conv[1:] != conv[:-1]))
            runs = np.diff(np.append(begins, len(conv)))
            cum = np.cumsum(n)
            pos = np.arange(1, len(conv) + 1) - np.repeat(begins, runs)
            sums = cum - np.repeat(cum[begins] - n[begins], runs)
            pos[: runs[0]] += rows
            sums[: runs[0]] += size
            last, rows, size = conv[-1], int(pos[-1]), int(sums[-1])
            yield pa.RecordBatch.from_arrays([b.column("conv"), pa.array(pos), b.column("key"), b.column("bytes"), pa.array(sums)], ["conv", "pos", "key", "bytes", "cum"])

    return df.mapInArrow(place, "conv long, pos long, key binary, bytes long, cum long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, key, bytes, rest: bytes from this turn on) and conversations (conv, len, total bytes)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), key.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    rows = written(placed(rows))
    first = F.array(*(F.sum(F.when(F.col("pos") <= k, F.col("bytes")).otherwise(0)) for k in range(MOST + 1)))
    convs = written(rows.groupBy("conv").agg(F.count("*").alias("n"), F.sum("bytes").alias("size"), first.alias("first")))
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"), F.col("first").alias("base_first"))
    info = convs.withColumn("base", F.col("conv") - F.pmod("conv", F.lit(GROUP))).withColumn("h", shared_turns(F.col("conv"))).join(bases, "base", "left")
    info = info.withColumn("shared", F.least("h", F.coalesce("base_n", F.lit(0))).cast("int"))
    head = F.coalesce(F.expr("base_first[shared]"), F.lit(0))
    info = written(info.select("conv", "base", "h", "shared", "size", (F.col("shared") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"), (head + F.col("size") - F.expr("first[h]")).alias("total")))
    own = rows.join(info.select("conv", "h", "shared", "size"), "conv").filter("pos > h")
    own = own.select("conv", (F.col("pos") - F.col("h") + F.col("shared")).alias("depth"), "key", "bytes", (F.col("size") - F.col("cum") + F.col("bytes")).alias("rest"))
    heads = rows.filter((F.col("pos") <= MOST) & (F.pmod("conv", F.lit(GROUP)) == 0)).withColumnRenamed("conv", "base")
    heads = heads.join(info.select("conv", "base", "shared", "total"), "base").filter("pos <= shared")
    heads = heads.select("conv", F.col("pos").alias("depth"), "key", "bytes", (F.col("total") - F.col("cum") + F.col("bytes")).alias("rest"))
    return written(own.unionByName(heads)), info.select("conv", "len", "total")


def _hashed(members: DataFrame) -> DataFrame:
    """rep, sha: the SHA-256 of each group's decimal ids (rep, conv) in order."""
    blocks = members.groupBy("rep", F.shiftright("conv", BLOCK).alias("block")).agg(F.concat_ws(",", F.sort_array(F.collect_list("conv")).cast("array<string>")).alias("ids"))
    blocks = blocks.repartition("rep").sortWithinPartitions("rep", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rep, digest = None, None
        for b in batches:
            done: list[tuple] = []
            for r, ids in zip(b.column("rep").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if r == rep:
                    digest.update(b"," + ids.encode())
                    continue
                if digest:
                    done.append((rep, digest.hexdigest()))
                rep, digest = r, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_pylist([{"rep": r, "sha": s} for r, s in done])
        if digest:
            yield pa.RecordBatch.from_pylist([{"rep": rep, "sha": digest.hexdigest()}])

    return blocks.select("rep", "ids").mapInArrow(run, "rep long, sha string")


def _sequences(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The distinct sequences: rep (its smallest conversation), m conversations, len, total bytes, sha of their ids."""
    lanes = [F.bit_xor(F.xxhash64(F.lit(k), F.col("depth"), F.col("key"))).alias(f"x{k}") for k in range(4)]
    names = ["len", *(f"x{k}" for k in range(4))]
    known = convs.join(turns.groupBy("conv").agg(*lanes), "conv", "left").fillna(0, names)
    known = written(known)
    groups = written(known.groupBy(*names).agg(F.min("conv").alias("rep"), F.count("*").alias("m"), F.min("total").alias("total")))
    several = known.join(groups.filter("m > 1").select(*names, "rep"), names).select("rep", "conv")
    alone = groups.filter("m = 1").select("rep", F.sha2(F.col("rep").cast("string").cast("binary"), 256).alias("sha"))
    return written(groups.select("rep", "m", "len", "total").join(alone.unionByName(_hashed(several)), "rep"))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns, convs = rebuilt(conversations)
    reps = _sequences(turns, convs)
    band = F.floor(F.log2("depth")).cast("int")
    at = written(turns.join(reps.select(F.col("rep").alias("conv"), "m", "len"), "conv").withColumnRenamed("conv", "rep").withColumn("band", band), "band")

    # The root: one class of all sequences. A class: id (its smallest member), reps sequences, and what a chain needs.
    one = lambda c: F.min(c).alias(c)
    root = reps.agg(F.min("rep").alias("conv_id"), F.count("*").alias("reps"), F.sum("m").cast("long").alias("n_convs"), F.min("total").alias("rest"), one("len")).filter("reps > 0")
    root = root.withColumn("bytes", F.lit(0).cast("long")).withColumn("parent", F.lit(None).cast("long"))
    levels = [written(root)]
    active = reps.select("rep", F.lit(min((r.conv_id for r in levels[0].collect()), default=None)).cast("long").alias("node"), "m", "len")
    ended = []
    while not levels[-1].filter("reps > 1").isEmpty():
        depth = len(levels)
        ended.append(active.filter(F.col("len") == depth - 1).select(F.col("node").alias("conv_id"), F.lit(depth - 1).cast("long").alias("depth"), "rep"))
        now = at.filter((F.col("band") == depth.bit_length() - 1) & (F.col("depth") == depth))
        met = written(active.filter(F.col("len") >= depth).join(now.select("rep", "key", "bytes", "rest"), "rep"))
        parts = met.groupBy("node", "key").agg(F.min("rep").alias("conv_id"), F.count("*").alias("reps"), F.sum("m").alias("n_convs"), one("rest"), one("len"), one("bytes"))
        parts = written(parts.withColumnRenamed("node", "parent"))
        levels.append(parts.drop("key"))
        split = parts.filter("reps > 1").select(F.col("parent").alias("node"), "key", F.col("conv_id").alias("child"))
        active = written(met.join(split, ["node", "key"]).select("rep", F.col("child").alias("node"), "m", "len"))

    # Fold back: a class with one sequence is a chain's top, others sum their children.
    nodes, below = [], None
    for depth in reversed(range(len(levels))):
        own = (F.col("n_convs") - 1) * F.col("bytes")
        chain = levels[depth].filter("reps = 1")
        here = chain.withColumns({"n_children": (F.col("len") > depth).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("rest")})
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("conv_id")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("below"))
            folded = levels[depth].filter("reps > 1").join(sums, "conv_id").withColumn("saved", own + F.col("below")).drop("below")
            here = here.unionByName(folded)
        below = written(here.withColumn("depth", F.lit(depth).cast("long")))
        nodes.append(below)

    core = nodes[0]
    for n in nodes[1:]:
        core = core.unionByName(n)
    core = core.select("conv_id", "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "reps", "len")
    tops = core.filter("reps = 1").select(F.col("conv_id").alias("rep"), F.col("depth").alias("top"))
    tails = at.join(tops.join(reps.select("rep", "sha"), "rep"), "rep").filter("depth > top")
    tails = tails.select(
        F.col("rep").alias("conv_id"), "depth", F.col("rep").alias("parent_conv_id"), F.col("m").alias("n_convs"), (F.col("depth") < F.col("len")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        ((F.col("m") - 1) * F.col("rest")).alias("saved_tokens"), F.when(F.col("depth") == F.col("len"), F.col("sha")).otherwise(NONE).alias("ends_sha256"),
    )
    ends = core.filter("reps = 1 and len = depth").select("conv_id", "depth", F.col("conv_id").alias("rep"))
    for e in ended:
        ends = ends.unionByName(e)
    ends = ends.join(reps.select("rep", "sha"), "rep").select("conv_id", "depth", "sha")
    core = core.join(ends, ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("sha", F.lit(NONE)))
    return core.select(*NODE).unionByName(tails.select(*NODE))

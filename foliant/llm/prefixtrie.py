"""A prefix trie of conversations from chained digests of their turns.

Each conversation's turns pass in order through a chain of SHA-256 digests, so that one digest stands for a whole
prefix; every prefix becomes a row, and rows of one (depth, digest) are a node. A node's name is its smallest member
with its depth. The nodes that one conversation names are the end of its own path, a chain: wherever it is the smallest
member, it is so further down. So a subtree sum needs no row for each pair of a node and an ancestor, of which a long
conversation has the square of its turns: each chain is exploded to the chains above it, at the depth where the path
leaves them, with its own sums, and within a chain the sums run upwards. The rows of that are no more than the turns.

What families share (see rebuilt()) and the order of turns come from one shuffle by family. Hot nodes, such as a first turn that many
share, are pre-aggregated before they are shuffled, and meet their members in a join that adaptive execution can split. The ids that end
at a node are put together in buckets of neighbouring ids before they are hashed in order, as a stream.

Defined results: a null role or text is empty; turns are ordered by turn, null first, and turns of one number by the
digest of their role and text, repeated rows each count; rows without an id are left out; an empty table has no nodes;
other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.session import cut_table

#: Ids of one bucket of those that end at a node.
BUCKET = 4096
#: Families of FAMILY neighbouring ids share the first turns of the least of them, at most HEADS - 1.
FAMILY, HEADS = 5, 9
#: Rows of an output batch.
STEP_ROWS = 8192
_EMPTY = hashlib.sha256().digest()


def turns(table: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(c, turn, own, bytes): the digest of each turn's role and text, and the bytes of its text."""
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    own = F.unhex(F.sha2(F.concat(F.octet_length(by).cast("string"), F.lit(":"), by, said).cast("binary"), 256))
    return table.select(F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), own.alias("own"), F.octet_length(said).cast("long").alias("bytes")).where(F.col("c").isNotNull())


def borrowed(c: Column) -> Column:
    """How many turns a conversation takes from the first of its family."""
    return F.crc32(c.cast("string")) % HEADS


class _Rows:
    """Collects rows and gives them in batches."""

    def __init__(self, schema: pa.Schema) -> None:
        self.schema, self.columns = schema, [[] for _ in schema]

    def add(self, *row: object) -> None:
        for column, value in zip(self.columns, row, strict=True):
            column.append(value)

    def full(self, least: int = STEP_ROWS) -> Iterator[pa.RecordBatch]:
        if len(self.columns[0]) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(self.columns, self.schema, strict=True)], schema=self.schema)
            self.columns = [[] for _ in self.schema]


_PREFIX = pa.schema([("c", pa.int64()), ("depth", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64()), ("ends", pa.bool_())])


def prefixes(table: DataFrame, families: bool = True) -> DataFrame:
    """(c, depth, digest, bytes, ends): each prefix of each conversation, the textless one included. With families, every
    conversation c is rebuilt from the first turns of conversation c - c % 5 and its own later ones."""
    c = F.col("c")
    first = c - c % FAMILY if families else c
    dealt = turns(table).select(first.alias("first"), (c != first).alias("follows"), "c", "turn", "own", "bytes", (borrowed(c) if families else F.lit(0)).cast("int").alias("take"))
    dealt = dealt.repartition("first").sortWithinPartitions("first", "follows", "c", F.asc_nulls_first("turn"), "own")

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(_PREFIX)
        now = family = None
        head: list[tuple[bytes, int]] = []
        depth = seen = take = 0
        digest, length = _EMPTY, 0
        follows = False

        def step(own: bytes, n: int) -> None:  # a prefix is known to end only when the next row comes
            nonlocal digest, depth, length
            rows.add(now, depth, digest, length, False)
            digest, depth, length = hashlib.sha256(digest + own).digest(), depth + 1, n

        for batch in batches:
            for first, follower, c, own, n, t in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)), strict=True):
                if c != now:
                    if now is not None:
                        rows.add(now, depth, digest, length, True)
                    if first != family:
                        family, head = first, []
                    now, follows, seen, take, digest, depth, length = c, follower, 0, t, _EMPTY, 0, 0
                    if follows:
                        for given in head[:take]:
                            step(*given)
                seen += 1
                if not follows:
                    if seen < HEADS:
                        head.append((own, n))
                    step(own, n)
                elif seen > take:
                    step(own, n)
            yield from rows.full()
        if now is not None:
            rows.add(now, depth, digest, length, True)
        yield from rows.full(1)

    return dealt.mapInArrow(chain, "c long, depth long, digest binary, bytes long, ends boolean")


_PART = pa.schema([("c", pa.int64()), ("depth", pa.int64()), ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ending", pa.int64())])
_PART_DDL = "c long, depth long, parent long, n_convs long, n_children long, n_leaves long, saved long, ending long"


def trie(table: DataFrame, families: bool = True) -> DataFrame:
    """The nodes of the trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    paths = cut_table(prefixes(table, families))
    nodes = cut_table(paths.groupBy("depth", "digest").agg(F.min("c").alias("owner"), F.count("*").alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends")))
    top = nodes.where("depth = 0").first()
    if top is None:
        return table.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    fields = ["c", "depth", "bytes", "ends", "owner", "n_convs", "n_ends"]
    below = paths.where("depth > 0").join(nodes.where("depth > 0"), ["depth", "digest"]).select(*fields)
    # all share the root: it is known, and not joined
    at_root = paths.where("depth = 0").select("c", "depth", "bytes", "ends", F.lit(top["owner"]).alias("owner"), F.lit(top["n_convs"]).alias("n_convs"), F.lit(top["n_ends"]).alias("n_ends"))
    # hashed anew: by "c" alone the join's hot keys would have to be put together again before they are split
    met = below.unionByName(at_root).repartition(F.col("c")).sortWithinPartitions("c", "depth")

    def climb(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Nodes of each conversation's own chain; the chain's sums at each chain above, where the path leaves it;
        and where each conversation ends."""
        rows = _Rows(_PART)
        now, above, own, last = None, [], [], None

        def leave() -> None:
            # above: (owner, depth) where the path leaves the chains over its own; own: (depth, n_convs, saved, ended by all)
            rows.add(last[0], last[1], None, None, None, None, None, now)
            if not own:
                return
            parent = above[-1][0] if above else None
            for k, (d, n, saved, leaf) in enumerate(own):
                rows.add(now, d, parent if k == 0 else now, n, int(k + 1 < len(own)), int(leaf), saved, None)
            saved, leaves = sum(x[2] for x in own), int(own[-1][3])
            for k, (o, d) in enumerate(above):
                rows.add(o, d, None, None, int(k + 1 == len(above)), leaves, saved, None)

        for batch in batches:
            for c, d, n_bytes, owner, n, n_ends in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4, 5, 6)), strict=True):
                if c != now:
                    if now is not None:
                        leave()
                        yield from rows.full()
                    now, above, own = c, [], []
                last = owner, d
                if owner == c:
                    own.append((d, n, (n - 1) * n_bytes, n == n_ends))
                elif above and above[-1][0] == owner:
                    above[-1] = owner, d
                else:
                    above.append((owner, d))
        if now is not None:
            leave()
        yield from rows.full(1)

    parts = cut_table(met.mapInArrow(climb, _PART_DDL))
    sums = [F.max("parent").alias("parent"), F.max("n_convs").alias("n_convs"), *(F.sum(x).alias(x) for x in ("n_children", "n_leaves", "saved"))]
    counted = parts.where("ending is null").groupBy("c", "depth").agg(*sums)
    ends = _end_hashes(parts.where("ending is not null").select("c", "depth", "ending"))
    upwards = Window.partitionBy("c").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    whole = counted.withColumns({"n_leaves": F.sum("n_leaves").over(upwards), "saved": F.sum("saved").over(upwards)})
    return whole.join(ends, ["c", "depth"], "left").select(
        F.col("c").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def _end_hashes(ends: DataFrame) -> DataFrame:
    """(c, depth, sha): the digest of the ids, in order, that end at each node."""
    bucket = F.shiftright("ending", BUCKET.bit_length() - 1)
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("ending")), lambda x: x.cast("string")), ",")
    put = ends.groupBy("c", "depth", bucket.alias("bucket")).agg(ids.alias("ids")).repartition("c", "depth").sortWithinPartitions("c", "depth", "bucket")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(pa.schema([("c", pa.int64()), ("depth", pa.int64()), ("sha", pa.string())]))
        now, sha = None, None
        for batch in batches:
            for c, d, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 3)), strict=True):
                if (c, d) == now:
                    sha.update(b"," + ids.encode())
                    continue
                if now is not None:
                    rows.add(*now, sha.hexdigest())
                now, sha = (c, d), hashlib.sha256(ids.encode())
            yield from rows.full()
        if now is not None:
            rows.add(*now, sha.hexdigest())
        yield from rows.full(1)

    return put.mapInArrow(run, "c long, depth long, sha string")


def digest(table: DataFrame) -> DataFrame:
    return trie(table)


#: The checksum is spelt out bit by bit: v holds each byte of the decimal id, and seven zeros after it.
SQL = """
WITH said AS (
  SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), own AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, own) AS pos
  FROM (SELECT c, turn, sha256(octet_length(encode(role)) || ':' || role || text) AS own, octet_length(encode(text)) AS bytes FROM said)
), convs AS (
  SELECT c, c - c % 5 AS first, xor(4294967295, list_reduce(v, lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384))) % 9 AS h
  FROM (SELECT c, [4294967295::UBIGINT] || flatten(list_transform(string_split(c::VARCHAR, ''), lambda x: [ascii(x)::UBIGINT, 0, 0, 0, 0, 0, 0, 0])) AS v FROM (SELECT DISTINCT c FROM own))
), rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, pos) AS depth, own, bytes FROM (
    SELECT v.c, 0 AS part, o.pos, o.own, o.bytes FROM convs v JOIN own o ON o.c = v.first AND o.pos <= v.h
    UNION ALL SELECT c, 1, pos, own, bytes FROM own JOIN convs USING (c) WHERE pos > h)
), paths AS (
  SELECT c, depth, string_agg(own, '') OVER (PARTITION BY c ORDER BY depth) AS key, bytes, depth = max(depth) OVER (PARTITION BY c) AS ends FROM rebuilt
  UNION ALL SELECT c, 0, '', 0, c NOT IN (SELECT c FROM rebuilt) FROM convs
), nodes AS (
  SELECT depth, key, min(c) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(bytes) AS saved, count(*) = count_if(ends) AS leaf,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256
  FROM paths GROUP BY depth, key
), sums AS (
  SELECT p.depth, p.key, sum(n.saved) AS saved, count_if(n.leaf) AS leaves, count_if(n.depth = p.depth + 1) AS children
  FROM nodes n JOIN paths p ON p.c = n.conv_id AND p.depth <= n.depth GROUP BY p.depth, p.key
)
SELECT n.conv_id, n.depth, up.conv_id AS parent_conv_id, n.n_convs, s.children AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.key = n.key
LEFT JOIN nodes up ON n.depth > 0 AND up.depth = n.depth - 1 AND up.key = n.key[: len(n.key) - 64]
"""

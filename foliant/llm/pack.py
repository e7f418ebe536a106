"""Best-fit packing of tokenised documents into sequences by a grouping genetic algorithm.

Documents become runs of token ids; only those longer than a sequence are cut. Pieces are dealt by hash into
groups of bounded size. Each group is evolved on several islands: a crossover injects whole well-filled bins
of one parent into the other, removes the bins that hold the same pieces, and best-fits the displaced ones;
between epochs each island receives its neighbour's elite. The best island packs the group. The pieces of
poorly filled bins of all groups are dealt again, until one group is left.

Defined results: null reads as an empty text, which is the end token alone; repeated rows are packed each;
an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import functools
import json
import os
import random
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.llm.common import append_column, blank_words
from foliant.session import cut

CAPACITY = 4096
END_ID = 1
#: Pieces in a group: bounds the memory and time of one island.
GROUP_PIECES = 4096
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 30
POPULATION = 8
#: Loose pieces up to which the local search also tries pairs of them.
PAIR_PIECES = 64
#: Bins filled less than this share are dealt again.
POOR = 0.98
#: Dealing again goes on while it spares this share of the bins that are dealt.
WORTH_DEALING = 0.001
#: Bytes of text tokenised at a time.
STEP_BYTES = 2_000_000
#: Words whose ids a worker remembers; of more, the half that was asked for last.
MOST_WORDS = 200_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """The ids of words. A tokenizer of this kind never joins text across a blank, nor a letter with a comma, so
    every distinct word is tokenised once while it is remembered. Words of Latin letters need none of the tokenizer's normalisation
    but lower case and go straight to its model."""

    plain = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(file)
        steps = json.loads(self.whole.to_str())
        kinds = [x.get("type") for x in (steps.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        if kinds != ["Split", "ByteLevel"] or [x.get("type") for x in (steps.get("normalizer") or {}).get("normalizers", [])] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("only lower-casing tokenizers that split at blanks and marks")
        self.model = self.whole.model
        own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in own]
        self.letters = np.arange(256, dtype="<u4")  # how byte-level models spell bytes
        self.letters[rest] = 0x100 + np.arange(len(rest))
        self.letters[0x0A] = 0x0A  # stands between words
        # words: those that are remembered; of each, the number of its ids, one after the other in flat, and the step that asked for it last
        self.words = pa.array([], pa.string())
        self.flat, self.size, self.used, self.step = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _forget(self) -> None:
        """Keeps the half of the words that was asked for last."""
        keep = np.sort(np.argsort(-self.used, kind="stable")[: MOST_WORDS // 2])
        first, size = (np.cumsum(self.size) - self.size)[keep], self.size[keep]
        self.flat = self.flat[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        self.words, self.size, self.used = self.words.take(pa.array(keep)), size, self.used[keep]

    def _tokenised(self, plain: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after the other, number of each word's ids)."""
        ids, size, tokenize = array("I"), array("q"), self.model.tokenize
        raw = np.frombuffer("\n".join(plain).lower().encode(), np.uint8)
        for spelt in self.letters[raw].tobytes().decode("utf-32-le").split("\n") if plain else []:
            own = [x.id for x in tokenize(spelt)]
            ids.extend(own)
            size.append(len(own))
        for at in range(0, len(others), 10_000):
            for e in self.whole.encode_batch_fast(others[at : at + 10_000], add_special_tokens=False):
                own = e.ids
                ids.extend(own)
                size.append(len(own))
        return np.frombuffer(ids, "<u4"), np.frombuffer(size, np.int64)

    def ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first place, number of ids) of each of some different words in the third, all ids that are remembered."""
        if len(self.words) > MOST_WORDS:
            self._forget()
        self.step += 1
        at = pc.index_in(words, value_set=self.words).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        fresh = words.take(pa.array(new))
        plain = pc.match_substring_regex(fresh, self.plain)
        kinds, order = [fresh.filter(plain), fresh.filter(pc.invert(plain))], np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")
        ids, size = self._tokenised(*(k.to_pylist() for k in kinds))
        at[new[order]] = len(self.words) + np.arange(len(new))
        self.words = pa.concat_arrays([self.words, *kinds])
        self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, size])
        self.used = np.concatenate([self.used, np.zeros(len(new), np.int64)])
        self.used[at] = self.step
        return (np.cumsum(self.size) - self.size)[at], self.size[at], self.flat


@functools.lru_cache(maxsize=1)
def _encoder(file: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(file)


def encode(column: pa.Array, file: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(rows, ids, first id of each row + total)."""
    encoder = _encoder(file)
    for rows, words, codes, firsts in blank_words(column, STEP_BYTES):
        first, size, flat = encoder.ids(words)
        sizes = size[codes]
        done = np.concatenate([[0], np.cumsum(sizes)])
        ids = flat[np.repeat(first[codes] - done[:-1], sizes) + np.arange(done[-1])] if done[-1] else np.zeros(0, "<u4")
        yield rows, ids, done[firsts]


_PIECES = T.ArrayType(
    T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType())])
)


def _pieces(column: pa.Array, file: str, capacity: int) -> pa.Array:
    offsets, piece, start, length, crc = [0], [], [], [], []
    for rows, ids, bounds in encode(column, file):
        for r in range(rows):
            own = np.append(ids[bounds[r] : bounds[r + 1]], np.uint32(END_ID)).astype("<u4")
            for k, at in enumerate(range(0, len(own), capacity)):
                part = own[at : at + capacity]
                piece.append(k)
                start.append(at)
                length.append(len(part))
                crc.append(zlib.crc32(part.tobytes()))
            offsets.append(len(piece))
    values = pa.StructArray.from_arrays([pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["piece", "start", "length", "ids_crc32"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


# ---- the genetic algorithm ------------------------------------------------------------------------

Bin = tuple[int, tuple[int, ...]]  # load, pieces


def best_fit(bins: list[Bin], loose: list[int], lengths: list[int], capacity: int) -> list[Bin]:
    """bins and the loose pieces, longest first, each put where the least room is left."""
    room = sorted((capacity - load, k) for k, (load, _) in enumerate(bins) if load < capacity)
    loads, parts = [b[0] for b in bins], [list(b[1]) if b[0] < capacity else b[1] for b in bins]
    for p in sorted(loose, key=lambda i: -lengths[i]):
        n = lengths[p]
        at = bisect_left(room, (n, -1))
        if at == len(room):
            loads.append(n)
            parts.append([p])
            k = len(loads) - 1
        else:
            k = room.pop(at)[1]
            loads[k] += n
            parts[k].append(p)
        if loads[k] < capacity:
            insort(room, (capacity - loads[k], k))
    return [(load, tuple(part)) for load, part in zip(loads, parts, strict=True)]


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones."""
    return -len(bins), sum((load / capacity) ** 2 for load, _ in bins)


def exchange(bins: list[Bin], loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> tuple[list[Bin], list[int]]:
    """Local search before loose pieces are best-fitted: a bin gives one or two pieces for one or two loose ones that
    fill it better; what it gives is smaller and finds a place more easily. Each exchange fills a bin further, so it ends."""
    out = list(bins)
    free = sorted((lengths[p], p) for p in loose)
    order = [k for k, (load, _) in enumerate(out) if load < capacity]
    rng.shuffle(order)
    for k in order:
        better = True
        while better and free and out[k][0] < capacity:
            better = False
            load, part = out[k]
            room = capacity - load
            gives = [(lengths[p], (p,)) for p in part]
            if len(part) <= 8:
                gives += [(lengths[p] + lengths[q], (p, q)) for x, p in enumerate(part) for q in part[:x]]
            best: tuple[int, tuple[int, ...], tuple[int, ...]] | None = None
            for size, give in gives:
                at = bisect_left(free, (size + room + 1, -1)) - 1
                if at >= 0 and free[at][0] > size and (best is None or free[at][0] - size > best[0]):
                    best = free[at][0] - size, give, (at,)
                if len(free) <= PAIR_PIECES and (best is None or best[0] < room):
                    low, high = 0, len(free) - 1
                    while low < high:  # the pair of loose pieces that comes nearest to size + room
                        both = free[low][0] + free[high][0]
                        if both > size + room:
                            high -= 1
                        else:
                            if both > size and (best is None or both - size > best[0]):
                                best = both - size, give, (low, high)
                            low += 1
            if best:
                gain, give, take = best
                out[k] = load + gain, tuple(p for p in part if p not in give) + tuple(free[t][1] for t in take)
                for t in sorted(take, reverse=True):
                    del free[t]
                for p in give:
                    insort(free, (lengths[p], p))
                better = True
    return out, [p for _, p in free]


def placed_anew(bins: list[Bin], loose: list[int], lengths: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    bins, loose = exchange(bins, loose, lengths, capacity, rng)
    return best_fit(bins, loose, lengths, capacity)


def cross(a: list[Bin], b: list[Bin], lengths: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """Well-filled bins of b put whole into a; bins of a with the same pieces go, and what they lose is placed anew."""
    full = sorted(b, key=lambda x: -x[0])[: max(1, len(b) // 2)]
    gift = rng.sample(full, max(1, len(full) // 3))
    given = {p for _, part in gift for p in part}
    kept, loose = [], []
    for load, part in a:
        if given.isdisjoint(part):
            kept.append((load, part))
        else:
            loose += [p for p in part if p not in given]
    return placed_anew(kept + gift, loose, lengths, capacity, rng)


def mutate(bins: list[Bin], lengths: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    """The emptiest bins and a few others are opened and their pieces placed anew."""
    order = sorted(range(len(bins)), key=lambda k: bins[k][0])
    opened = set(order[: max(2, len(bins) // 100)]) | set(rng.sample(range(len(bins)), min(len(bins), 3)))
    return placed_anew([b for k, b in enumerate(bins) if k not in opened], [p for k in opened for p in bins[k][1]], lengths, capacity, rng)


def fewest(lengths: list[int], capacity: int) -> int:
    """A lower bound of the number of bins: for each size a, pieces above capacity - a have bins of their own, those
    above one half too, and the others from a on fill at best the room that the latter leave."""
    x = np.sort(np.array(lengths, np.int64))
    if not len(x):
        return 0
    total = np.concatenate([[0], np.cumsum(x)])
    half = int(np.searchsorted(x, capacity // 2, "right"))
    a = np.unique(np.concatenate([[0], x[:half]]))
    big = np.searchsorted(x, capacity - a, "right")
    small = np.searchsorted(x, a, "left")
    n_big, n_half = len(x) - big, np.maximum(0, big - half)
    room = n_half * capacity - (total[np.maximum(big, half)] - total[half])
    rest = total[half] - total[np.minimum(small, half)] - room
    return int((n_big + n_half + np.maximum(0, -(-rest // capacity))).max())


def evolve(lengths: list[int], elites: list[list[int]], seed: int, capacity: int, generations: int = GENERATIONS) -> list[int]:
    """The bin of each piece in the best packing that an island finds; elites are packings to start from. A packing
    that meets the lower bound ends the search."""
    rng = random.Random(seed)
    least = fewest(lengths, capacity)
    people: list[list[Bin]] = []
    for elite in elites:
        by_bin: dict[int, list[int]] = {}
        for p, k in enumerate(elite):
            by_bin.setdefault(k, []).append(p)
        people.append([(sum(lengths[p] for p in part), tuple(part)) for part in by_bin.values()])
    if not people:
        people.append(best_fit([], list(range(len(lengths))), lengths, capacity))
    while len(people) < POPULATION and len(people[0]) > least:
        # half of a packing that is known, and the rest placed in an order of its own
        half = [b for b in people[rng.randrange(len(people))] if rng.random() < 0.5]
        inside = {p for _, part in half for p in part}
        people.append(placed_anew(half, [p for p in range(len(lengths)) if p not in inside], lengths, capacity, rng))
    rank = lambda x: fitness(x, capacity)
    for _ in range(generations):
        people.sort(key=rank, reverse=True)
        if len(people[0]) <= least or len(people) < 2:
            break
        a, b = people[rng.randrange(max(1, len(people) // 2))], people[rng.randrange(1, len(people))]
        children = [cross(a, b, lengths, capacity, rng), cross(b, a, lengths, capacity, rng), mutate(people[0], lengths, capacity, rng)]
        seen: dict[tuple[int, float], list[Bin]] = {}
        for x in [*people, *children]:  # packings of one fitness are one individual, so that the population stays varied
            seen.setdefault(rank(x), x)
        people = sorted(seen.values(), key=rank, reverse=True)[:POPULATION]
    best = max(people, key=rank)
    out = [0] * len(lengths)
    for k, (_, part) in enumerate(best):
        for p in part:
            out[p] = k
    return out


def _epoch(state: DataFrame, capacity: int, epoch: int, generations: int) -> DataFrame:
    """(group, island, lengths, bins, fit) after one epoch; state may hold its own and a migrant elite."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                elites = [e for e in row["elites"] if e]
                bins = evolve(row["lengths"], elites, hash((row["group"], row["island"], epoch)), capacity, generations)
                loads = np.bincount(bins, weights=row["lengths"])
                yield pa.RecordBatch.from_pylist(
                    [{"group": row["group"], "island": row["island"], "lengths": row["lengths"], "bins": bins, "fit": float(-len(loads) + ((loads / capacity) ** 2).mean())}],
                    pa.schema([("group", pa.int64()), ("island", pa.int32()), ("lengths", pa.list_(pa.int64())), ("bins", pa.list_(pa.int32())), ("fit", pa.float64())]),
                )

    return state.mapInArrow(run, "group long, island int, lengths array<long>, bins array<int>, fit double")


def _pack_groups(groups: DataFrame, many: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(group, bins): the best packing of each of many groups over its islands, which run side by side."""
    state = groups.select(
        "group",
        F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
        F.transform("pieces", lambda p: p["length"]).alias("lengths"),
        F.array().cast("array<array<int>>").alias("elites"),
    ).repartition(max(1, min(many * islands, 16 * int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))), F.xxhash64("group", "island"))
    for epoch in range(epochs):
        state = cut(_epoch(state, capacity, epoch, generations))
        if epoch + 1 < epochs:
            migrants = state.select("group", ((F.col("island") + 1) % islands).alias("island"), F.col("bins").alias("migrant"))
            state = state.join(migrants, ["group", "island"]).select("group", "island", "lengths", F.array("bins", "migrant").alias("elites"))
    return state.groupBy("group").agg(F.max_by("bins", F.struct("fit", F.negative("island"))).alias("bins"))


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    tokenizer_file: str | None = None,
    capacity: int = CAPACITY,
    group_pieces: int = GROUP_PIECES,
    islands: int = ISLANDS,
    epochs: int = EPOCHS,
    generations: int = GENERATIONS,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document goes."""
    file = tokenizer_file or default_tokenizer()
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    cut_up = append_column(own, "text", "pieces", _PIECES, lambda c: _pieces(c, file, capacity))
    pieces = cut(cut_up.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.inline("pieces")).withColumn("uid", F.monotonically_increasing_id()).drop("row"))
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    done = pieces.where(F.col("length") >= capacity).select(*fields, (F.lit(-1) - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = pieces.where(F.col("length") < capacity).select("uid", *fields)
    deal, before = 0, None
    while n := todo.count():
        many = -(-n // group_pieces)
        groups = cut(
            todo.groupBy(F.pmod(F.xxhash64("uid", F.lit(deal)), F.lit(many)).alias("group"))
            .agg(F.sort_array(F.collect_list(F.struct("length", "uid", "doc_id", "piece", "start", "ids_crc32")), asc=False).alias("pieces"))
        )
        best = _pack_groups(groups, many, capacity, islands, epochs, generations)
        placed = (
            groups.join(best, "group")
            .select("group", F.inline(F.arrays_zip("pieces", "bins")))
            .select("group", F.col("bins").alias("bin"), "pieces.*")
            .groupBy("group", "bin").agg(F.sum("length").alias("load"), F.sort_array(F.collect_list(F.struct("length", "uid", "doc_id", "piece", "start", "ids_crc32")), asc=False).alias("parts"))
        )
        placed = cut(placed)
        poor = placed.where(F.col("load") < int(POOR * capacity))
        # pieces are dealt again until one group is left, or until that no longer spares one bin of a thousand
        after = placed.count()
        last = many == 1 or (before is not None and before - after < WORTH_DEALING * before)
        before = after if last else poor.count()
        good = placed if last else placed.where(F.col("load") >= int(POOR * capacity))
        sequence = F.lit(deal) * F.lit(1 << 56) + F.col("group") * F.lit(1 << 20) + F.col("bin")
        rows = good.select(
            sequence.alias("sequence_id"),
            F.inline(
                F.transform("parts", lambda p, i: F.struct(p.alias("p"), F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0).cast("long"), lambda s, x: s + x["length"]).alias("offset")))
            ),
        )
        done = done.unionByName(rows.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "offset"))
        if last:
            break
        todo = poor.select(F.inline("parts")).select("uid", *fields)
        deal += 1
    return done.select(*fields, "sequence_id", "offset")


def digest(docs: DataFrame) -> DataFrame:
    return pack(docs)

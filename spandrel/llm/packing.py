"""Filling containers of fixed capacity with items of varying length.

Variable-capacity best fit: items of a shard are placed in falling order of length, each into the
open container with the least room that still takes it.  If there is none, a container is opened of
the size of least cost.  A size's cost is that of all containers of it that what is still to be placed
would take: their number, times capacity and ``opening``, the tokens that any container costs besides,
plus the room that this item leaves in it and that none of the shorter items still to be placed fits.
So sizes compete for every container: with a high ``opening`` the largest is opened as long as much is
left, and smaller ones for the rest; without, each item opens the size that it fills best.  At the end
each container is downsized to the smallest permitted capacity that holds its contents.  With one
permitted capacity this is best fit decreasing.

Only an item above the largest capacity is split: into full containers of its own and a rest that is
placed like any other item.

Items are spread over shards of about SHARD items by a hash of their ids, so that every shard has the
same mixture of lengths; only ids and lengths are shuffled, never texts.  Each shard wastes at most
its last containers.  Then the contents of each shard's containers that are less than FULL full are
placed once more, together with those of WIDER shards, so that this rest doesn't add up.

Container ids are 'shard-number' and depend on the rows alone, not on files, tasks or their order.

Defined results: null and empty texts have no tokens and need no container; they are returned with a
null container.  Repeated rows are items each.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.functions.arrow import batch, map_arrow, parts
from spandrel.session import settled

#: What a container costs besides its capacity, in tokens.
OPENING = 64
#: Items of a shard, on average.
SHARD = 8_192
#: Shards whose unfilled containers are placed once more together.
WIDER = 64
#: A container is left as it is from this part of its capacity on.
FULL = 0.98
#: The default vocabulary; any file of ranks in this format will do.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: How that vocabulary's tokenizer parts a text; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Counts of parts that a Python worker remembers.
REMEMBERED = 400_000


class TokenCounts(dict):
    """Tokens of a part of a text; a part starts where white space follows something else.

    The tokenizer never joins across such a place, so the parts' counts add up to the text's.
    """

    part = regex.compile(r"\s*\S+|\s+").findall

    def __init__(self, vocabulary: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(vocabulary).open("rb"))}
        self.encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> int:
        n = len(self.encode(part))
        if part[-1:] < "0" or part[-1:] > "9":
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = n
        return n

    def of(self, text: str) -> int:
        return sum(map(self.__getitem__, self.part(text)))


@lru_cache(2)
def counter(vocabulary: str) -> TokenCounts:
    return TokenCounts(vocabulary)


def token_lengths(df: DataFrame, item_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """item_id, n_tokens; 0 for null and empty texts.  The vocabulary is a file of the driver's; it is sent to the executors."""
    df.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        count = counter(SparkFiles.get(name)).of
        for b in parts(batches):
            yield batch([b.column(0), [count(t) if t else 0 for t in b.column(1).to_pylist()]], schema)

    return map_arrow(df.select(item_id, text), run, f"`{item_id}` {df.schema[item_id].dataType.simpleString()}, n_tokens BIGINT")


def best_fit(sizes: Sequence[int], capacities: Sequence[int], opening: int = OPENING) -> list[tuple[int, list[int]]]:
    """(capacity, item numbers) of each container; no size may exceed the largest capacity."""
    capacities = sorted(capacities)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = sum(sizes)
    smallest = sizes[order[-1]] if order else 0
    room: list[tuple[int, int]] = []  # sorted: room left, container
    bins: list[tuple[int, list[int]]] = []
    used: list[int] = []
    for i in order:
        need = sizes[i]
        at = bisect.bisect_left(room, (need, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            lost = lambda c: c - need if c - need < smallest else 0
            free = min((c for c in capacities if c >= need), key=lambda c: (-(-left // c) * (c + opening + lost(c)), -c))
            b = len(bins)
            bins.append((free, []))
            used.append(0)
        bins[b][1].append(i)
        used[b] += need
        left -= need
        if free > need:
            bisect.insort(room, (free - need, b))
    return [(next(c for c in capacities if c >= u), items) for u, (_, items) in zip(used, bins)]


def pack(lengths: DataFrame, item_id: str, n_tokens: str, capacities: Sequence[int] = (2048,), shard: int = SHARD, wider: int = WIDER, full: float = FULL, opening: int = OPENING) -> DataFrame:
    """item_id, piece, first_token, n_tokens, container, capacity, place: one row per piece of an item.

    place is the piece's first token in the container.  lengths are read twice, for their number and
    for themselves: settle them before if they are costly.
    """
    capacities = tuple(sorted(capacities))
    most = capacities[-1]
    id_type = lengths.schema[item_id].dataType.simpleString()
    lengths = lengths.select(F.col(item_id).alias("_id"), F.coalesce(F.col(n_tokens), F.lit(0)).cast("long").alias("n_tokens"))
    shards = max(1, round(lengths.count() / shard))
    out = ["_id", "piece", "first_token", "n_tokens", "container", "capacity", "place"]
    ddl = f"_shard BIGINT, _id {id_type}, piece INT, first_token BIGINT, n_tokens BIGINT, container STRING, capacity INT, place BIGINT"
    most_held = 4 * shard

    def placed(rows: DataFrame, prefix: str, final: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            """Rows in the order of shards; one shard, or most_held rows of one, is held at a time."""

            def fill(name: str, shard_no: int, items: list[tuple]) -> pa.RecordBatch:
                cols: list[list] = [[] for _ in schema]

                def add(*values) -> None:
                    for c, v in zip(cols, (shard_no, *values)):
                        c.append(v)

                rest, own = [], 0
                for rid, piece, first, n in items:
                    for _ in range((n - 1) // most if n else 0):
                        add(rid, piece, first, most, f"{name}-w{own}", most, 0)
                        piece, first, n, own = piece + 1, first + most, n - most, own + 1
                    if n:
                        rest.append((rid, piece, first, n))
                    else:
                        add(rid, piece, first, 0, None, None, None)
                for number, (capacity, inside) in enumerate(best_fit([r[3] for r in rest], capacities, opening)):
                    kept = final or sum(rest[i][3] for i in inside) >= full * most
                    place = 0
                    for i in inside:
                        add(*rest[i], f"{name}-{number}" if kept else None, capacity if kept else None, place if kept else None)
                        place += rest[i][3]
                return batch(cols, schema)

            now, held, part = None, [], 0
            for b in batches:
                for shard_no, *row in zip(*(c.to_pylist() for c in b.columns)):
                    if held and (shard_no != now or len(held) >= most_held):
                        yield fill(f"{prefix}{now}.{part}", now, held)
                        held, part = [], 0 if shard_no != now else part + 1
                    now = shard_no
                    held.append(tuple(row))
            if held:
                yield fill(f"{prefix}{now}.{part}", now, held)

        ordered = rows.repartition("_shard").sortWithinPartitions("_shard", "_id", "piece", "n_tokens")
        return map_arrow(ordered.select("_shard", "_id", "piece", "first_token", "n_tokens"), run, ddl)

    spread = F.pmod(F.xxhash64("_id"), F.lit(shards)).alias("_shard")
    first = placed(lengths.select(spread, "_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), "n_tokens"), "a", False)
    first = settled(first)  # read for what is kept and for what is placed once more
    unfilled = F.col("container").isNull() & (F.col("n_tokens") > 0)
    second = placed(first.where(unfilled).withColumn("_shard", F.floor(F.col("_shard") / wider)), "b", True)
    return first.where(~unfilled).select(*out).unionByName(second.select(*out)).withColumnRenamed("_id", item_id)

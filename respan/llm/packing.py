"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token pieces of at most ``capacity`` tokens (only longer documents are
cut, the first piece takes the remainder so that the others are full).  Full pieces are
sequences of their own.  All other pieces are dealt by hash into *regions* of about
:data:`REGION` pieces; each region is packed by :data:`ISLANDS` islands that evolve their own population of packings:

* a packing is a list of bins; its fitness is the mean squared fill (Falkenauer);
* crossover injects whole well-filled bins of one parent into the other, removes the
  bins that now hold duplicate pieces, and best-fits the displaced pieces, largest first;
* mutation empties a few of the worst bins and best-fits their pieces again;
* after each epoch the islands' elites migrate: every island of a region receives the
  elites of the others (a shuffle by region), and the best packing of the last epoch wins.

Piece lengths decide everything, so a region moves (piece number, length) pairs only.

Defined cases: a null text is empty and still has its end token, so it is one piece of
length 1; an empty table gives no rows; equal lengths are ordered by piece key, so
results do not depend on partitioning; repeated rows are packed each for itself
(they are told apart by a running number among equal rows); extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from respan.llm.util import batched, bound_batches, stored

CAPACITY = 2048
#: Pieces a region aims at; islands a region, epochs with migration, crossovers an epoch.
REGION, ISLANDS, EPOCHS, CROSSOVERS, POPULATION = 8192, 2, 2, 10, 5
#: Sequence numbers set apart for a region: packed ones from 0, full pieces from the middle.
BINS = 1 << 24
#: Entries of a task's memory of word ids; it is emptied when full and when the task ends
#: (a worker process goes on to other stages' tasks).
MEMORY = 600_000


def _byte_of_character() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the
    characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class WordIds(dict):
    """Token ids (little-endian unsigned 32-bit bytes) of a word with one space before it.

    The byte-level pre-tokeniser never joins text across a space that is followed by a
    non-space character, so ids of a text are the ids of its parts cut before such spaces.
    Parts are encoded from the vocabulary file's own ranks by a faster encoder, which gives the
    same ids; texts with a special token's string go through the tokenizer itself.
    """

    def __init__(self, tokenizer):
        import public_tokenizers
        import tiktoken

        super().__init__()
        self.tokenizer = tokenizer
        self.specials = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        to_byte = _byte_of_character()
        ranks = {bytes(map(to_byte.__getitem__, t)): i for t, i in tokenizer.get_vocab(with_added_tokens=False).items()
                 if t not in self.specials}
        self.fast = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        encode = self.fast.encode_ordinary
        return [array("I", encode(t)).tobytes() for t in texts]

    def encode_whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def parts(self, text: str) -> list[str]:
        """Parts of ``text`` without the space that starts each but the first."""
        parts = text.split(" ")
        if _SPACES.search(text):
            merged = [parts[0]]
            for p in parts[1:]:
                if p and not p[0].isspace():
                    merged.append(p)
                else:
                    merged[-1] += " " + p
            parts = merged
        return parts

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of every text, as bytes."""
        split = [None if any(s in t for s in self.specials) else self.parts(t) for t in texts]
        new = {p for parts in split if parts for p in parts[1:] if p not in self}
        if len(self) + len(new) > MEMORY:
            self.clear()
            new = {p for parts in split if parts for p in parts[1:]}
        self.update(zip(new, self.encode([" " + p for p in new]), strict=True))
        heads = [self.encode_whole(t) if parts is None else self.encode(parts[:1])[0]
                 for t, parts in zip(texts, split, strict=True)]
        get = self.__getitem__
        return [h if parts is None else h + b"".join(map(get, parts[1:]))
                for h, parts in zip(heads, split, strict=True)]


#: A space before white space or the end, where the parts are not those of a plain split.
_SPACES = re.compile(r" (?!\S)")
_WORDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer of a vocabulary file (made once a process)."""
    if path not in _WORDS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _WORDS[path] = WordIds(Tokenizer.from_file(path))
    return _WORDS[path]


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id",
                 text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, copy, piece, start, length, ids_crc32[, ids]) of every document.

    ``copy`` tells repeated rows apart only by what they hold (equal rows are equal)."""
    bound_batches(docs.sparkSession, 8 * 1024 * 1024)
    fields = [("doc_id", pa.int64()), ("key", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
              ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(tokenizer_path)
        end, wide = b"\0\0\0\0", 4 * capacity
        for cols in batched(batches):
            out: list[list] = [[] for _ in schema]
            for d, key, ids in zip(cols["d"], cols["key"], words.ids([t or "" for t in cols["t"]]), strict=True):
                ids += end
                edges = [0, *range(len(ids) % wide or wide, len(ids) + 1, wide)]
                for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    piece = ids[a:b]
                    row = (d, key, k, a // 4, (b - a) // 4, zlib.crc32(piece)) + ((piece,) if with_ids else ())
                    for col, v in zip(out, row, strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)],
                                             schema=schema)
        words.clear()

    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.xxhash64(F.col(text)).alias("key"),
                       F.col(text).alias("t"))
    ddl = "doc_id long, key long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return rows.mapInArrow(cut, ddl)


# ---------------------------------------------------------------- the packings
class Packing:
    """Bins of piece numbers, with the free room of each."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.room = capacity, [], []

    def fitness(self) -> float:
        fill = 1 - np.asarray(self.room) / self.capacity
        return float((fill * fill).mean()) if self.room else 0.0

    def best_fit(self, items: list[int], size: list[int]) -> None:
        """Each piece, largest first, into the bin with the least sufficient room (the
        latest such bin), or a new one."""
        at: dict[int, list[int]] = {}
        mask = 0  # bit r is set if some bin has room r
        for b, r in enumerate(self.room):
            at.setdefault(r, []).append(b)
            mask |= 1 << r
        for i in sorted(items, key=lambda i: (-size[i], i)):
            s = size[i]
            fits = mask >> s
            if fits:
                r = s + (fits & -fits).bit_length() - 1
                b = at[r].pop()
                if not at[r]:
                    mask ^= 1 << r
                self.bins[b].append(i)
            else:
                r, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.room.append(r)
            self.room[b] = r = r - s
            at.setdefault(r, []).append(b)
            mask |= 1 << r


def crossover(a: Packing, b: Packing, size: list[int], rng: np.random.Generator) -> Packing:
    """``a`` with the best-filled bins of ``b`` injected."""
    take = min(len(b.bins), max(1, int(len(b.bins) * rng.uniform(0.2, 0.6))))
    order = np.argsort(np.asarray(b.room) + rng.uniform(0, 1, len(b.room)), kind="stable")[:take]
    injected = [b.bins[k] for k in order]
    inside = {i for group in injected for i in group}
    child = Packing(a.capacity)
    child.bins = [list(g) for g in injected]
    child.room = [b.room[k] for k in order]
    displaced = []
    for group, room in zip(a.bins, a.room, strict=True):
        kept = [i for i in group if i not in inside]
        if len(kept) == len(group):
            child.bins.append(list(group))
            child.room.append(room)
        else:
            displaced += kept
    child.best_fit(displaced, size)
    return child


def mutated(a: Packing, size: list[int], rng: np.random.Generator) -> Packing:
    """``a`` with its emptiest bins and some random ones packed anew."""
    n = len(a.bins)
    worst = set(np.argsort(-np.asarray(a.room), kind="stable")[: max(1, n // 50)].tolist())
    worst |= set(rng.choice(n, min(n, max(1, n // 20)), replace=False).tolist())
    out = Packing(a.capacity)
    out.bins = [list(g) for k, g in enumerate(a.bins) if k not in worst]
    out.room = [r for k, r in enumerate(a.room) if k not in worst]
    out.best_fit([i for k in sorted(worst) for i in a.bins[k]], size)
    return out


def evolve(size: list[int], capacity: int, seeds: list[list[list[int]]], seed: int,
           crossovers: int = CROSSOVERS, population: int = POPULATION) -> Packing:
    """One epoch of an island; ``seeds`` are packings that migrated in (lists of bins)."""
    rng = np.random.default_rng(seed)
    people = []
    for bins in seeds:
        p = Packing(capacity)
        p.bins = [list(g) for g in bins]
        p.room = [capacity - sum(size[i] for i in g) for g in bins]
        people.append(p)
    least = -(-sum(size) // capacity)
    if not people:
        first = Packing(capacity)
        first.best_fit(list(range(len(size))), size)
        people.append(first)
    while len(people) < population and len(people[0].bins) > least:
        people.append(mutated(people[int(rng.integers(len(people)))], size, rng))
    people.sort(key=lambda p: (len(p.bins), -p.fitness()))
    for _ in range(crossovers):
        if len(people[0].bins) <= least:  # no packing has fewer bins
            break
        i, j = sorted(rng.choice(len(people), 2, replace=False).tolist())
        child = crossover(people[i], people[j], size, rng)
        people.append(mutated(child, size, rng) if rng.random() < 0.3 else child)
        people.sort(key=lambda p: (len(p.bins), -p.fitness()))
        people = people[:population]
    return people[0]


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, region: int = REGION, islands: int = ISLANDS,
                epochs: int = EPOCHS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every region packed on its islands."""
    cols = pieces.columns
    n_regions = max(1, round(pieces.where(F.col("length") < capacity).count() / region))
    dealt = pieces.withColumn("region", F.pmod(F.xxhash64("doc_id", "key", "piece", "copy", F.lit(9)),
                                               F.lit(n_regions)).cast("long"))
    is_full = F.col("length") >= capacity
    order = Window.partitionBy("region", is_full).orderBy("doc_id", "key", "piece", "copy")
    dealt = stored(dealt.withColumn("no", F.row_number().over(order) - 1), "packing-regions")
    full = dealt.where(is_full).withColumn("sequence_id", F.col("region") * BINS + F.lit(BINS // 2) + F.col("no"))
    numbered = dealt.where(~is_full)

    def island(keys, frame: pd.DataFrame, epoch: int) -> Packing:
        size = frame.drop_duplicates("no").sort_values("no")["length"].tolist()
        seeds = []
        if epoch:
            for _, one in frame.sort_values(["elite", "bin", "no"]).groupby("elite"):
                edges = np.flatnonzero(np.diff(one["bin"].to_numpy())) + 1
                seeds.append([g.tolist() for g in np.split(one["no"].to_numpy(), edges)])
        return evolve(size, capacity, seeds, seed=hash((int(keys[0]), int(keys[1]), epoch)) & 0x7FFFFFFF)

    def epoch_of(epoch: int):
        def run(keys, frame: pd.DataFrame) -> pd.DataFrame:
            best = island(keys, frame, epoch)
            return pd.DataFrame({"region": keys[0], "elite": keys[1], "bins": len(best.bins),
                                 "fitness": best.fitness(),
                                 "bin": np.repeat(np.arange(len(best.bins)), [len(g) for g in best.bins]),
                                 "no": [i for g in best.bins for i in g]}).merge(
                frame.drop_duplicates("no")[["no", "length"]], on="no")
        return run

    ddl = "region long, elite int, bins int, fitness double, bin int, no int, length long"
    lanes = F.explode(F.array(*[F.lit(i) for i in range(islands)])).alias("island")
    state = (numbered.select("region", "no", "length", lanes).groupBy("region", "island")
             .applyInPandas(epoch_of(0), ddl))
    for e in range(1, epochs):  # migration: every island of a region gets all elites
        state = (state.select("region", "elite", "bin", "no", "length", lanes).groupBy("region", "island")
                 .applyInPandas(epoch_of(e), ddl))
    state = stored(state, "packing-elites")
    best = (state.groupBy("region").agg(F.min_by("elite", F.struct("bins", -F.col("fitness"), "elite")).alias("elite")))
    place = (Window.partitionBy("region", "bin").orderBy("no")
             .rowsBetween(Window.unboundedPreceding, -1))
    placed = (state.join(best, ["region", "elite"]).select("region", "bin", "no", "length")
              .withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0)).cast("long")))
    packed = (numbered.join(placed.select("region", "no", "bin", "offset"), ["region", "no"])
              .withColumn("sequence_id", F.col("region") * BINS + F.col("bin")))
    return packed.select(*cols, "sequence_id", "offset").unionByName(
        full.withColumn("offset", F.lit(0).cast("long")).select(*cols, "sequence_id", "offset"))


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, doc_id: str = "doc_id",
         text: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    pieces = stored(token_pieces(docs, tokenizer_path, capacity, doc_id, text), "packing-pieces")
    # equal rows are numbered so that each copy is a piece of its own
    same = Window.partitionBy("doc_id", "key", "piece").orderBy("start")
    pieces = pieces.withColumn("copy", F.row_number().over(same))
    out = pack_pieces(pieces, capacity)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")

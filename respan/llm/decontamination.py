"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders; all other words count by their
lower-cased letters.  Windows of :data:`WINDOW` such tokens are hash-joined between
documents and benchmark items, which also finds questions whose slots were filled anew.
The tokens they cover on one diagonal (document position minus item position) are then walked: a
run counts while the slots are consistent, i.e. each item value always became the same document
value and the reverse; from a slot that disagrees it goes on just past the earlier one.  An item
leaks into a document if a consistent run covers :data:`RUN` tokens, or the whole of a shorter item.

Windows are looked up in three readings: by their plain lower-cased words; with the capitalised
words that do not begin a sentence as names; and with all capitalised words as names but
:data:`NEVER_NAMES`, so a passage matches wherever its first word stands.  An attached unit is a token of its own
(``5km``), currency signs and ordinal endings belong to the number.  A window with fewer
words outside placeholders than half of it grows until it holds :data:`SPARSE` such words,
so number-heavy questions match by longer runs and bare tables of numbers only if equal.

Scale: bitmaps of fixed size with the benchmark's words and windows sift the documents where
they are read (they can only let too many pass).  A window matches only if each of its tokens is a
slot or a word of the benchmark, so only stretches of such tokens are hashed at all; windows
that pass meet the benchmark's in a join whose hot keys adaptive execution may split.

Defined cases: null and empty texts match nothing; items below :data:`LEAST` words are no
evidence and never match; repeated items are answered each by item_id; repeated rows of
documents are told apart by id and text; null ids are kept; extra columns are ignored;
empty tables give no rows; long texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respan.llm.util import batched, bitmap, bound_batches, in_bitmap, span_hashes, stored, window_hashes

WINDOW, RUN, LEAST = 8, 13, 5
#: Words outside placeholders that a window among many numbers needs.
SPARSE = RUN // 2
BITS = 24
EDGE = b" \t\r\n.,;:!?\"'()[]{}<>*_"
_CURRENCY = "(?:" + "|".join("$€£¥₹").replace("$", r"\$") + ")"
_NUMBER = re.compile(f"{_CURRENCY}?[+-]?{_CURRENCY}?([0-9](?:[0-9.,:/%-]*[0-9%])?){_CURRENCY}?[.,:/-]*".encode())
NUMBER_WORDS = frozenset(b"zero one two three four five six seven eight nine ten eleven twelve thirteen "
                         b"fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty "
                         b"seventy eighty ninety hundred thousand million billion trillion".split())
UNITS = frozenset(b"mm cm m km in ft yd mi mg g kg lb lbs oz ml l gal s sec min h hr ms kb mb gb tb w kw v a hz "
                  b"inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers "
                  b"gram grams kilogram kilograms pound pounds ounce ounces liter liters litre litres gallon "
                  b"gallons second seconds minute minutes hour hours day days week weeks month months year years "
                  b"dollar dollars cent cents euro euros percent degrees".split())
ORDINALS = frozenset((b"st", b"nd", b"rd", b"th"))
NEVER_NAMES = frozenset(b"what which who whom whose when where why how the an this that these those it its he she they "
                        b"we you his her their our my your is are was were do does did has have had can could will "
                        b"would shall should may might must if in on at of to for from by with as and or but not no "
                        b"there then than so".split())
_NUM, _NAME, _UNIT = (np.uint64(x) for x in (0x4E554D, 0x4E414D45, 0x554E4954))


class Tokens(dict):
    """Token table of a task: the number of each word, and by number the hash of its lower-cased
    core, its canonical hash and flags (1 capitalised, 2 ends a sentence, 4 number or unit, 8 a
    second token is attached, 16 that is a unit, 32 capitalised but never a name, 64 may stand in a
    benchmark window: a slot, or a word in the bitmap ``known``)."""

    def __init__(self, known: np.ndarray | None = None):
        import xxhash

        super().__init__()
        self.known, self.digest = known, xxhash.xxh3_64_intdigest
        if known is not None:
            self.bits, self.shift = known.view(np.uint8).tobytes(), 64 - (len(known).bit_length() + 5)
        self.forget()

    def forget(self):
        self.clear()
        #: the first two rows stand for all words that no benchmark window holds (the second ends a sentence)
        self.rows: list[tuple[int, int, int, int]] = [] if self.known is None else [(0, 0, 0, 0), (0, 0, 2, 0)]
        self.canon, self.raw, self.more = (np.empty(0, np.uint64) for _ in range(3))
        self.flags = np.empty(0, np.uint8)

    def __missing__(self, word: bytes) -> int:
        if self.known is not None:
            n = self.unknown(word)
            if n is not None:
                self[word] = n
                return n
        n = self[word] = len(self.rows)
        self.rows.append(_token(word))
        return n

    def unknown(self, word: bytes) -> int | None:
        """The shared row of a lower-case word of letters that is no slot and not in the benchmark."""
        core = word.strip(EDGE)
        if core.isascii():
            if not (core.isalpha() and core.islower()) or core in NUMBER_WORDS or core in UNITS:
                return None
        else:
            text = core.decode("utf-8", "replace")
            if not (text.isalpha() and text.islower() and text.lower() == text):
                return None
        at = self.digest(core) >> self.shift
        if self.bits[at >> 3] >> (at & 7) & 1:
            return None
        return int(_ends(word)) if core != word else 0

    def numbers(self, text: bytes) -> np.ndarray:
        """The number of each of a text's words; the table's columns cover them."""
        if len(self) > 600_000:
            self.forget()
        words = text.split()
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if len(self.canon) < len(self.rows):
            raw, canon, flags, more = zip(*self.rows[len(self.canon):], strict=True)
            raw, flags, more = np.array(raw, np.uint64), np.array(flags, np.uint8), np.array(more, np.uint64)
            if self.known is not None:
                may = in_bitmap(raw, self.known) | (flags & (1 | 4 | 8) != 0)
                flags |= np.where(may, np.uint8(64), np.uint8(0))
            self.canon = np.concatenate([self.canon, np.array(canon, np.uint64)])
            self.raw, self.more = np.concatenate([self.raw, raw]), np.concatenate([self.more, more])
            self.flags = np.concatenate([self.flags, flags])
        return at

    def stretches(self, at: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
        """(first word, end, first token) of the stretches of at least ``least`` tokens that may all stand in a
        benchmark window; no window of another place can match."""
        flags = self.flags[at]
        may = flags & 64 != 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], may, [False]])))
        first, end = edge[::2], edge[1::2]
        two = flags & 8 != 0
        extra = np.concatenate([[0], np.cumsum(two)]) if two.any() else None
        if extra is None:
            keep = end - first >= least
            return zip(first[keep].tolist(), end[keep].tolist(), first[keep].tolist(), strict=True)
        keep = end - first + extra[end] - extra[first] >= least
        first, end = first[keep], end[keep]
        return zip(first.tolist(), end.tolist(), (first + extra[first]).tolist(), strict=True)

    def forms(self, at: np.ndarray, before: int | None) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Plain hashes of the tokens of some consecutive words (``before``: the word ahead of them), and their forms
        (canonical hashes, is a slot): with all capitalised words as names, and if it differs with
        those that begin no sentence."""
        canon, raw, flags = self.canon[at], self.raw[at], self.flags[at]
        slot, inside = flags & 4 != 0, flags & 1 != 0
        name = inside & (flags & 32 == 0)
        # the first word of a text begins a sentence, as does a word after one's end
        inside[:1] &= before is not None and not self.flags[before] & 2
        inside[1:] &= flags[:-1] & 2 == 0
        two = np.flatnonzero(flags & 8)
        if len(two):
            times = np.ones(len(at), np.int64)
            times[two] = 2
            second = np.cumsum(times)[two] - 1
            canon, raw, slot, name, inside = (np.repeat(x, times) for x in (canon, raw, slot, name, inside))
            unit = flags[two] & 16 != 0
            raw[second] = self.more[at[two]]
            canon[second] = np.where(unit, _UNIT, raw[second])
            slot[second], name[second], inside[second] = unit, False, False
        forms = [(np.where(name, _NAME, canon), slot | name)]
        if (inside != name).any():
            forms.append((np.where(inside, _NAME, canon), slot | inside))
        return raw, forms

    def of(self, text: bytes) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Plain hashes and forms of a whole text."""
        return self.forms(self.numbers(text), None)


def _ends(word: bytes) -> bool:
    """Whether a word ends a sentence."""
    return word.rstrip(b"\"')]}>*_")[-1:] in (b".", b"!", b"?", b":")


def _token(word: bytes) -> tuple[int, int, int, int]:
    """(plain hash, canonical hash, flags, plain hash of the attached token) of a word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    core = word.strip(EDGE) or word
    ends = 2 * _ends(word)
    if core.isascii():
        low = core.lower()
        capital = len(core) > 1 and 65 <= core[0] <= 90 and not 65 <= core[1] <= 90
    else:
        text = core.decode("utf-8", "replace")
        low = text.lower().encode()
        capital = len(text) > 1 and text[0].isupper() and not text[1].isupper()
    if low in NUMBER_WORDS or b"-" in low and all(w in NUMBER_WORDS for w in low.split(b"-")):
        return digest(low), int(_NUM), 4 | ends, 0
    if low in UNITS:
        return digest(low), int(_UNIT), 4 | ends, 0
    number = _NUMBER.match(low)
    if number:
        rest = low[number.end():]
        if not rest or rest in ORDINALS:
            return digest(low), int(_NUM), 4 | ends, 0
        if rest.split(b"-")[0] in UNITS:  # 5km, 20-year, 20-year-old
            return digest(low[:number.end()].rstrip(b".,:/-")), int(_NUM), 4 | 8 | 16 * (rest in UNITS) | ends, digest(rest)
    raw = digest(low)
    return raw, raw, (capital and (33 if low in NEVER_NAMES else 1)) | ends, 0


def sparse_spans(slot: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, length) of the windows longer than WINDOW that hold just SPARSE words outside
    placeholders: from each token to the last such word, and to each token from the first.
    Tokens more than ``near`` before the first (after the last) cannot decide a run."""
    at, words = np.arange(len(slot)), np.flatnonzero(~slot)
    if len(words) < SPARSE:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    k = np.searchsorted(words, at)
    begin = at[k + SPARSE <= len(words)]
    k = k[:len(begin)]
    ahead = words[k] - begin <= near
    begin, last = begin[ahead], words[k[ahead] + SPARSE - 1]
    k = np.searchsorted(words, at, "right")
    end = at[k >= SPARSE]
    k = k[len(at) - len(end):]
    behind = end - words[k - 1] <= near
    end, first = end[behind], words[k[behind] - SPARSE]
    spans = np.unique(np.stack([np.r_[begin, first], np.r_[last, end]], axis=1), axis=0)
    # a window of WINDOW tokens does where it holds enough words
    count = np.concatenate([[0], np.cumsum(~slot)])
    a, b = spans[:, 0], spans[:, 1] + 1
    head = count[np.minimum(a + WINDOW, len(slot))] - count[a]
    tail = count[b] - count[np.maximum(b - WINDOW, 0)]
    long = (b - a > WINDOW) & (2 * np.minimum(head, tail) < WINDOW)
    return a[long], (b - a)[long]


def windows(raw: np.ndarray, forms: list[tuple[np.ndarray, np.ndarray]], width: int,
            near: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first, length, is of the last form, is a slot) of all windows: of ``width`` tokens by
    their plain words and in each form that has enough words, and the longer ones among
    numbers.  The last form has the plain windows where it lacks words."""
    n = len(raw) - width + 1
    if n <= 0:
        return
    plain = window_hashes(raw, width)
    hashes, enough = [], []
    for canon, slot in forms:
        words = np.concatenate([[0], np.cumsum(~slot)])
        enough.append(2 * (words[width:] - words[:n]) >= width)
        hashes.append(np.where(enough[-1], window_hashes(canon, width), plain) if slot.any() else plain)
    last, lengths = hashes[-1], np.full(n, width)
    yield plain, np.arange(n), lengths, plain == last, forms[0][1]
    seen = [plain]
    for (canon, slot), h, ok in zip(forms, hashes, enough, strict=True):
        at = np.flatnonzero(np.logical_and.reduce([h != other for other in seen]))
        seen.append(h)
        if len(at):
            yield h[at], at, lengths[at], h[at] == last[at], slot
        if width == WINDOW and not ok.all():
            first, length = sparse_spans(slot, near)
            yield span_hashes(canon, first, length), first, length, np.zeros(len(first), bool), slot


def _window_rows(frame: DataFrame, widths, near: int, sieve=None, least: int = LEAST) -> DataFrame:
    """(h, width, key, id, pos, n, last, raw, slots) rows of ``frame`` (key, id, t); ``raw`` holds
    the window's plain hashes, ``slots`` a byte a token, 1 for slots.  ``widths`` None: WINDOW or the whole
    of a shorter text.  ``sieve``: bitmaps of the benchmark's windows and of its words; only stretches of
    at least ``least`` tokens that may stand in its windows are hashed."""
    schema = pa.schema([("h", pa.int64()), ("width", pa.int32()), ("key", pa.int64()), ("id", pa.int64()),
                        ("pos", pa.int32()), ("n", pa.int32()), ("last", pa.bool_()), ("raw", pa.binary()), ("slots", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, known = sieve.value if sieve is not None else (None, None)
        tokens = Tokens(known)
        for cols in batched(batches):
            out: list[list] = [[] for _ in schema]
            for key, d, t in zip(cols["key"], cols["id"], cols["t"], strict=True):
                numbers = tokens.numbers(t or b"")
                places = [(0, len(numbers), 0)] if known is None else tokens.stretches(numbers, least)
                for a, b, ahead in places:
                    raw, forms = tokens.forms(numbers[a:b], numbers[a - 1] if a else None)
                    n = len(raw)
                    if n < LEAST:
                        continue
                    for width in widths or (min(WINDOW, n),):
                        for h, first, length, last, slot in windows(raw, forms, width, near):
                            at = np.flatnonzero(in_bitmap(h, bits)) if bits is not None else np.arange(len(h))
                            if not len(at):
                                continue
                            spans = list(zip(first[at].tolist(), length[at].tolist(), strict=True))
                            for values, col in zip((h[at].view(np.int64).tolist(), length[at].tolist(), [key] * len(at),
                                                    [d] * len(at), (first[at] + ahead).tolist(), [n] * len(at),
                                                    last[at].tolist(), [raw[i:i + k].tobytes() for i, k in spans],
                                                    [slot[i:i + k].tobytes() for i, k in spans]), out, strict=True):
                                col += values
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)],
                                             schema=schema)

    return frame.mapInArrow(run, "h long, width int, key long, id long, pos int, n int, last boolean, "
                                  "raw binary, slots binary")


def _words_bitmap(items: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over the plain hashes of the items' tokens."""
    schema = pa.schema([("w", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for cols in batched(batches):
            for t in cols["t"]:
                raw, _ = tokens.of(t or b"")
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(raw).view(np.int64))], schema=schema)

    return bitmap(items.mapInArrow(run, "w long"), "w", BITS)


def longest_run(hits: list[tuple]) -> int:
    """Most tokens of a run on one diagonal that windows (item position, width, document words, item
    words, slots) cover without a gap, with consistent slots.  A token is a slot if any window
    has it as one.  Where a slot disagrees with an earlier one, the run goes on from just past that one."""
    tokens: dict[int, tuple[bytes, bytes, bool]] = {}
    for pos, width, d_raw, i_raw, slots in hits:
        for j in range(width):
            old = tokens.get(pos + j)
            if old is None or slots[j] and not old[2]:
                tokens[pos + j] = i_raw[8 * j:8 * j + 8], d_raw[8 * j:8 * j + 8], bool(slots[j])
    best, begin, before = 0, 0, None
    there: dict[bytes, tuple[bytes, int]] = {}  # value -> what it became, and where last
    back: dict[bytes, tuple[bytes, int]] = {}
    for p in sorted(tokens):
        if p - 1 != before:
            begin = p
        before = p
        a, b, slot = tokens[p]
        if slot:
            for became, x, y in ((there, a, b), (back, b, a)):
                old = became.get(x)
                if old is not None and old[0] != y:
                    begin = max(begin, old[1] + 1)
                became[x] = (y, p)
        best = max(best, p + 1 - begin)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
          item_text: str = "text", run: int = RUN) -> DataFrame:
    """(key, doc_id, item_id, tokens, item_tokens) of each document and leaked item:
    ``tokens`` is the longest consistent run, by the reading with names inside sentences if that
    shows the leak alone, else by all readings; ``key`` a hash of id and text."""
    spark = docs.sparkSession
    bound_batches(spark)
    d = F.col(doc_id).cast("long")
    raw = F.col(text).cast("binary")
    rows = docs.select(F.xxhash64(d, raw).alias("key"), d.alias("id"), raw.alias("t"))
    items = benchmark.select(F.lit(0).cast("long").alias("key"), F.col(item_id).cast("long").alias("id"),
                             F.col(item_text).cast("binary").alias("t"))
    wanted = stored(_window_rows(items, None, run), "decontamination-items")
    # all tokens of a run stand in one stretch, so a stretch has as many as the shortest run that counts
    least = min(run, wanted.agg(F.min("n")).first()[0] or run)
    widths = tuple(sorted(r["width"] for r in wanted.where(F.col("width") <= WINDOW).select("width").distinct().collect()))  # LEAST to WINDOW
    if not widths:
        widths = (WINDOW,)
    sieve = spark.sparkContext.broadcast((bitmap(wanted, "h", BITS), _words_bitmap(items)))
    found = _window_rows(rows, widths, run, sieve, least)
    both = found.select("h", "width", "key", "id", "pos", "last", "raw", "slots").join(
        wanted.select("h", "width", F.col("id").alias("item_id"), F.col("pos").alias("at"), F.col("n").alias("item_tokens"),
                      F.col("raw").alias("item_raw"), F.col("last").alias("item_last")), ["h", "width"])
    # a diagonal holds a few windows for each position of the item
    diagonal = (both.groupBy("key", "id", "item_id", "item_tokens", (F.col("pos") - F.col("at")).alias("diagonal"))
                .agg(F.collect_set(F.struct("at", "width", "raw", "item_raw", "slots",
                                               (F.col("last") & F.col("item_last")).alias("last"))).alias("hits")))
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.int64()), ("tokens", pa.int32()),
                        ("item_tokens", pa.int32())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in batched(batches):
            keep = []
            for key, i, item, n, hits in zip(cols["key"], cols["id"], cols["item_id"], cols["item_tokens"], cols["hits"],
                                             strict=True):
                hits = [tuple(x.values()) for x in hits]
                got = longest_run([x[:5] for x in hits if x[5]])
                if got < min(run, n):
                    got = longest_run([x[:5] for x in hits])
                if got >= min(run, n):
                    keep.append((key, i, item, got, n))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(
                zip(*keep, strict=True) if keep else [[]] * 5, schema, strict=True)], schema=schema)

    judged = diagonal.mapInArrow(judge, "key long, doc_id long, item_id long, tokens int, item_tokens int")
    return judged.groupBy("key", "doc_id", "item_id").agg(F.max("tokens").alias("tokens"),
                                                          F.max("item_tokens").alias("item_tokens"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text",
                 item_id: str = "item_id", item_text: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; all columns are kept."""
    bad = leaks(docs, benchmark, doc_id, text, item_id, item_text, run)
    bad = stored(bad.select(F.col("doc_id").alias("_id1"), F.col("key").alias("_key1")).distinct(), "decontamination-leaks")
    mine = F.xxhash64(F.col(doc_id).cast("long"), F.col(text).cast("binary"))
    out = docs.withColumn("_key0", mine)
    return out.join(bad, (out["_key0"] == bad["_key1"]) & out[doc_id].cast("long").eqNullSafe(bad["_id1"]),
                    "left_anti").select(*docs.columns)

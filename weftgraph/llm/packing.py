"""Best-fit packing: documents into sequences of at most ``capacity`` tokens.

Texts are tokenized where they lie; a worker keeps the ids of the parts of words it has met, since the tokenizer
never joins what white space, or a mark beside a letter, parts. A document longer than the capacity is cut into pieces of the capacity and a rest.

Best-fit decreasing places the longest pieces first, each into the open sequence with the least room that still
holds it, found in a segment tree over remaining capacities. Pieces of one length are alike, and so are sequences
with the same room; ``plan`` therefore places them by runs, from the number of pieces of each length alone. Its
size depends on the capacity and not on the number of documents. Pieces then find their place by their rank among
those of their length, which is counted in salted groups, so that a very common length lands in many tasks.

Defined cases: a null or empty text is its end token alone; the string of one of the tokenizer's added tokens in a
text is that token; pieces of one length are placed in order of doc_id; repeated rows are packed as often as they
occur, each as a document of its own; a row without doc_id is packed like any other; an empty table gives an empty
result; other columns are ignored; texts of any length are read whole, in memory in proportion to the text.
"""

from __future__ import annotations

import os
import re
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm.cluster import cut, map_arrow, narrowed, take
from weftgraph.llm.words import Words, slices

CAPACITY = 2048
END = 0
#: Parts of words whose ids a worker keeps (about 170 bytes each) before it starts anew.
KEPT_WORDS = 400_000
MARK = "\x01"
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
MARKS = np.zeros(256, bool)
MARKS[33:127] = ~PLAIN[33:127]
MARKS[39] = False
#: First bytes of the letters from U+00C0 to U+017F.
LATIN = np.zeros(256, bool)
LATIN[0xC3:0xC6] = True


@cache
def encoder(path: str, kept_words: int | None = None) -> Encoder:
    return Encoder(path, kept_words)


class Encoder:
    """Ids of whole texts by a tokenizer file, with the ids of words met before."""

    def __init__(self, path: str, kept_words: int | None = None) -> None:
        self.kept_words = kept_words
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        special = self.tokenizer.get_added_tokens_decoder()
        if odd := [t.content for t in special.values() if t.normalized or t.single_word or t.lstrip or t.rstrip]:
            raise ValueError(f"added tokens that aren't found by their plain text: {odd}")
        self.special = {t.content.encode(): i for i, t in special.items()}
        # Texts are cut at these strings, so that what looks like one after lower-casing is ordinary text.
        self.cuts = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True)) + b")")
        self.tokenizer.encode_special_tokens = True
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.place: dict[bytes, int] = {}
        self.ids, self.starts, self.sizes = np.zeros(1 << 20, np.uint32), np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int32)
        self.used = 0

    def ids_of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and the number of each word's.

        Words are encoded many at a time, with a marking word between them that none of them holds.
        """
        texts = [w.decode("utf-8", "replace") for w in words]
        if any(MARK in t for t in texts):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.array([i for x in found for i in x], np.uint32), np.array([len(x) for x in found], np.int64)
        encode = self.tokenizer.encode_batch_fast
        ids = np.concatenate([np.array(encode([f" {MARK} ".join([*texts[at : at + 1024], ""])], add_special_tokens=False)[0].ids, np.uint32) for at in range(0, len(texts), 1024)])
        ends = np.flatnonzero(ids == self.mark)
        return ids[ids != self.mark], np.diff(ends, prepend=-1) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids (uint32) of all texts (large_binary) and the bounds of each text's ids, as the tokenizer itself gives them:
        the string of an added token is that token, wherever it stands, and parts the text around it."""
        holds = np.zeros(len(texts), bool)
        for token in self.special:
            holds |= np.asarray(pc.match_substring(texts, token))
        if not holds.any():
            return self.encode_ordinary(texts)
        parts = [self.cuts.split(texts[i].as_py()) if h else [texts[i].as_py()] for i, h in enumerate(holds.tolist())]
        ids, bounds = self.encode_ordinary(pa.array([p for own in parts for p in own[::2]], pa.large_binary()))
        held, at = [], 0
        for own in parts:
            for k, part in enumerate(own):
                held.append(np.array([self.special[part]], np.uint32) if k % 2 else ids[bounds[at] : bounds[at + 1]])
                at += k % 2 == 0
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in held])])
        return np.concatenate(held), sizes[np.concatenate([[0], np.cumsum([len(own) for own in parts])])].astype(np.int64)

    def encode_ordinary(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and bounds of texts that hold no string of an added token."""
        words = Words(texts, lower=True)
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        words.split(seams(words))
        codes, known = words.encoded()
        names = known.to_pylist()
        if len(self.place) > (self.kept_words or KEPT_WORDS):
            self.clear()
        get = self.place.get
        found = [get(w, -1) for w in names]
        place = np.array(found, np.int64)
        at = np.flatnonzero(place < 0)
        if len(at):
            new = [names[i] for i in at.tolist()]
            ids, sizes = self.ids_of(new)
            n, total = len(self.place), len(ids)
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            while n + len(new) > len(self.starts):
                self.starts, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.sizes))
            self.ids[self.used : self.used + total] = ids
            self.starts[n : n + len(new)] = self.used + np.cumsum(sizes) - sizes
            self.sizes[n : n + len(new)] = sizes
            self.used += total
            place[at] = np.arange(n, n + len(new))
            self.place.update(zip(new, range(n, n + len(new)), strict=True))
        place = place[codes]
        sizes = self.sizes[place].astype(np.int64)
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(self.starts[place] - (ends - sizes), sizes) + np.arange(int(ends[-1]))]
        return ids, np.concatenate([[0], ends])[words.bounds].astype(np.int64)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, with_ids: bool = False, kept_words: int | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every piece of ``docs`` (doc_id, text)."""

    def run(batch: pa.RecordBatch):
        for rows, texts in slices(batch):
            ids, bounds = encoder(tokenizer, kept_words).encode(texts)
            ids = ids.astype("<u4", copy=False)
            row, piece, start, length, crc, own = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                n = b - a + 1
                for at in range(0, n, capacity):
                    to = min(at + capacity, n)
                    held = ids[a + at : min(a + to, b)].tobytes() + (b"" if to < n else END.to_bytes(4, "little"))
                    row.append(i)
                    piece.append(at // capacity)
                    start.append(at)
                    length.append(to - at)
                    crc.append(zlib.crc32(held))
                    if with_ids:
                        own.append(np.frombuffer(held, "<i4"))
            columns = [rows["doc_id"].take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.list_(pa.int32()))] * with_ids, names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    docs = take(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs, run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def seams(words: Words) -> np.ndarray:
    """Places inside words at which the tokenizer always starts anew: between ASCII marks and a letter or digit.

    Marks are taken together with symbols outside ASCII, and an apostrophe with what follows, so that only letters of
    ASCII and of Latin blocks count and words with an apostrophe stay whole.
    """
    data = words.data
    if len(data) < 2:
        return np.zeros(0, np.int64)
    # Not the signs for times and divided, nor the dotted capital I, whose lower case ends in a mark.
    lead = LATIN[data[:-1]] & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0))
    opens, closes = PLAIN[data], PLAIN[data]
    opens[:-1] |= lead
    closes[1:] |= lead
    mark = MARKS[data]
    at = np.flatnonzero(mark[:-1] & opens[1:] | closes[:-1] & mark[1:]) + 1
    if (data == 39).any():
        word = np.searchsorted(words.starts, at, "right") - 1
        quotes = np.concatenate([[0], np.cumsum(data == 39)])
        at = at[quotes[words.ends[word]] == quotes[words.starts[word]]]
    return at


class Rooms:
    """Segment tree over remaining capacities 0..capacity: which hold an open sequence, and the least from r up."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.open = [False] * (2 * self.size)

    def set(self, room: int, is_open: bool) -> None:
        at = room + self.size
        self.open[at] = is_open
        while at > 1:
            at //= 2
            self.open[at] = self.open[2 * at] or self.open[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.size
        if self.open[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.open[at + 1]:
                at += 1
                while at < self.size:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.size
            at //= 2
        return None


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Runs of the best-fit decreasing packing of ``counts`` pieces by length.

    (length, rank, n, sequence, each, offset): the n pieces of this length from ``rank`` on lie in sequences from
    ``sequence`` on, ``each`` in one, the first in each at ``offset``.
    """
    rooms = Rooms(capacity)
    held: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: runs of sequences (first, how many)
    runs, made = [], 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            held[room].append((first, n))
            rooms.set(room, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = rooms.tightest(length)
            if room is None:
                # All open sequences are too full: the rest open new ones.
                room, each = capacity, capacity // length
                first, n = made, -(-left // each)
                made += n
            else:
                first, n = held[room].pop()
                if not held[room]:
                    rooms.set(room, False)
                each = room // length
            # After a piece the same sequence is the tightest that holds another, as long as one fits.
            used = min(n, -(-left // each))
            placed = min(left, used * each)
            runs.append((length, rank, placed, first, each, capacity - room))
            full = placed // each
            put(room - each * length, first, full)
            if used > full:
                put(room - (placed - full * each) * length, first + full, 1)
            put(room, first + used, n - used)
            rank, left = rank + placed, left - placed
    return runs


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False, kept_words: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their sequence_id and offset, and their ids if wanted.

    ``kept_words``: parts of words whose ids a worker keeps; fewer take less memory and more time.
    """
    rows = cut(pieces(docs, tokenizer or public_tokenizers.path("word_bpe_49k.json"), capacity, with_ids, kept_words))
    return place(rows, capacity)


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The written table ``rows`` (doc_id, piece, start, length, ids_crc32) with sequence_id and offset.

    The driver holds the number of pieces of each length (``capacity`` rows at most) and the plan that follows from
    them, which goes to the tasks.
    """
    spark = rows.sparkSession
    salt = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salt)).cast("int"))
    counts = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    totals = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = np.array(sorted(plan(totals, capacity)), np.int64).reshape(-1, 6)
    earlier = F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    before = counts.select("length", "salt", F.coalesce(earlier, F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = salted.withColumn("nth", nth).join(before, ["length", "salt"]).select(*rows.columns, (F.col("before") + F.col("nth")).alias("rank"))
    starts, names = runs[:, 0] << 48 | runs[:, 1], rows.columns

    def run(batch: pa.RecordBatch):
        length, rank = (np.asarray(batch[c]).astype(np.int64) for c in ("length", "rank"))
        own = runs[np.searchsorted(starts, length << 48 | rank, "right") - 1]
        within = rank - own[:, 1]
        each = own[:, 4]
        places = [pa.array(own[:, 3] + within // each), pa.array(own[:, 5] + within % each * length)]
        yield pa.RecordBatch.from_arrays([batch[c] for c in names] + places, names=[*names, "sequence_id", "offset"])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "sequence_id long", "offset long"])
    return map_arrow(narrowed(ranked, 8), run, fields)  # a fiftieth of the texts


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and the ids of each packed sequence, from pieces with their ids. A sequence holds the capacity at most."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))

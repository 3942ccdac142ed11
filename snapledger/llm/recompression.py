"""Substring deduplication by recompression: runs and pairs of word symbols get global names, so equal stretches of words
get equal symbols inside; shared high-level symbols settle long repeats, shared lower ones reveal where to look for the rest.

1. Rounds. The words of a text are its first symbols (64-bit hashes). Round 0 names maximal runs of one word. Each round
   after it splits the alphabet in two halves and names every pair of a left symbol followed by a right one. A name is a
   hash of what it stands for, so it is the same in all tasks. Which split the first `COUNTED` rounds take is decided for
   the whole corpus: a Spark job counts the pairs that each of `SPLITS` splits would name, and the most wins. `HIGH`
   rounds are done in all; a symbol then stands for some 20 words.
2. Long repeats. The windows of `WINDOW` words that begin in a high-level symbol are a block, named (96 bits) by the
   words it reaches over. A block that a document of smaller id has too is settled: all its words go, and as the
   smaller document has all its windows, it need not be looked at again. One shuffle of a row per block.
3. What is inside. For a window, symbols at its ends whose form depends on words outside are taken off in each round (a
   run at an end, then a right symbol at the left end, a left symbol at the right end). What stays after `LOW` rounds
   depends on the window's words alone. From these symbols the `TOGETHER` neighbours of least hash are the window's
   anchor; equal windows have equal anchors. A window that keeps fewer symbols is its own anchor. Successive windows
   mostly share an anchor, so a stretch of them is one row. (More rounds would take more off, which costs more rows.)
4. Reveal. An anchor is shared if it lies in documents of different ids: one shuffle by anchor, without settled blocks.
5. Verify. Only windows of shared anchors are named, by all that was taken off and the symbols that stay, which rebuild
   the window; with the anchor that makes 96 bits. A shuffle finds the least doc_id of each name.
6. Words under windows that also start in a document of smaller id go.

Hot groups: a task sees slices of `SLICE` bytes of text. A block, anchor or window that a slice finds in several
documents is decided there as far as the slice can; decided rows go on under names of their own, and a row or two stand
for the slice. So a passage that a third of all documents hold sends a row or two for each slice, not for each
document. Texts are shuffled once: all joins with texts read the same exchange.

A document is found by (doc, row): row is 0, and a hash of the text where a doc_id is null or has different texts.

Defined results: a null doc_id is neither smaller nor greater than another one, so such a document loses nothing and
takes nothing from others; documents of one doc_id take nothing from each other; repeated rows get equal results. Null
and empty texts have no words and an empty `kept`. Texts below `WINDOW` words keep all. Memory of a task grows with the
longest single text. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from snapledger.llm.common import cut, slices
from snapledger.llm.shingles import mix

WINDOW = 13
LOW, COUNTED, HIGH = 1, 2, 11  # rounds: before anchors are taken, whose split is decided by counting, in all
TOGETHER = 3  # neighbouring symbols in an anchor
SPLITS = 4
SLICE = 2 << 20
BROADCAST_IDS = 100_000  # of doc_ids with different texts, counted before
PIECE = 1 << 20  # bytes hashed at once

_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_BASE, _FIRST, _SECOND = (np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))
_INVERSE, _FIRST_INVERSE = (np.uint64(pow(int(v), -1, 1 << 64)) for v in (_BASE, _FIRST))
_BYTE = mix(np.arange(256, dtype=np.uint64))

OPEN, MARK, DECIDED = 0, 1, 2  # a row to be compared; a slice's stand-in; a row that its slice has decided


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of every text, and each text's first word (one entry more than texts)."""
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + n + 1]
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    raw, at = np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]
    inside = ~_SPACE[raw]
    border = np.zeros(len(raw) + 1, bool)
    border[at] = True
    starts = np.flatnonzero(inside & np.append(True, ~inside[:-1] | border[1:-1]))
    ends = np.flatnonzero(inside & np.append(~inside[1:] | border[1:-1], True)) + 1
    out, i = np.empty(len(starts), np.uint64), 0
    base, inverse = _powers(_BASE, PIECE), _powers(_INVERSE, PIECE)
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PIECE, "right")))
        piece = raw[starts[i] : ends[j - 1]]
        if len(piece) > len(base):
            base, inverse = _powers(_BASE, len(piece)), _powers(_INVERSE, len(piece))
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_BYTE[piece] * base[: len(piece)], out=total[1:])
        a, b = starts[i:j] - starts[i], ends[i:j] - starts[i]
        out[i:j] = mix((total[b] - total[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return out, np.searchsorted(starts, at)


def expanded(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... , n of them, for each begin."""
    end = np.cumsum(n)
    return np.repeat(begin - (end - n), n) + np.arange(end[-1] if len(end) else 0)


class Parse:
    """The symbols of a slice of texts, round by round."""

    def __init__(self, texts: pa.Array, splits: tuple[int, ...]):
        self.words, self.at = words(texts)
        n = len(self.words)
        first = np.zeros(n + 1, bool)
        first[self.at] = True
        new = first[:-1].copy()
        new[1:] |= self.words[1:] != self.words[:-1]
        self.run = np.cumsum(new) - 1
        self.run_at = np.append(np.flatnonzero(new), n)
        length = np.diff(self.run_at).astype(np.uint64)
        names = self.words[self.run_at[:-1]]
        self.symbols = np.where(length > 1, mix(names * _FIRST + length), names)
        self.first = first[self.run_at[:-1]]
        self.begin = self.run_at[:-1]  # first word of each symbol
        self.rounds: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # symbols, which are left ones, new symbol of each
        for split in splits:
            left, merged = self._halves(split)
            heads = np.ones(len(self.symbols), bool)
            heads[1:] = ~merged[:-1]
            self.rounds.append((self.symbols, left, np.cumsum(heads) - 1))
            at = np.flatnonzero(heads)
            after = self.symbols[np.minimum(at + 1, max(len(self.symbols) - 1, 0))]
            self.symbols = np.where(merged[at], mix(self.symbols[at] * _FIRST + after * _SECOND), self.symbols[at])
            self.first, self.begin = self.first[at], self.begin[at]

    def _halves(self, split: int) -> tuple[np.ndarray, np.ndarray]:
        left = mix(self.symbols ^ np.uint64(split)) & np.uint64(1) == 0
        merged = np.zeros(len(left), bool)
        merged[:-1] = left[:-1] & ~left[1:] & ~self.first[1:]
        return left, merged

    def pairs(self, split: int) -> int:
        """How many pairs a further round with this split would name."""
        return int(self._halves(split)[1].sum())

    def last(self, w: np.ndarray) -> np.ndarray:
        """One more than the last word at which a window of the same text may begin; w itself at least."""
        return np.maximum(self.at[self.owner(w) + 1] - WINDOW + 1, w)

    def owner(self, w: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, w, "right") - 1

    def windows(self) -> np.ndarray:
        """First word of every window."""
        return expanded(self.at[:-1], np.maximum(np.diff(self.at) - WINDOW + 1, 0))

    def blocks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First window of each top symbol, how many begin in the symbol, and two names of the words they reach over."""
        a = self.begin
        n = np.minimum(np.append(a[1:], len(self.words)), self.last(a)) - a
        a, n = a[n > 0], n[n > 0]
        names = []
        for base, inverse in ((_BASE, _INVERSE), (_FIRST, _FIRST_INVERSE)):
            total = np.zeros(len(self.words) + 1, np.uint64)
            np.cumsum(self.words * _powers(base, len(self.words)), out=total[1:])
            names.append(mix((total[a + n + WINDOW - 1] - total[a]) * _powers(inverse, len(self.words) + 1)[a] + n.astype(np.uint64)))
        return a, n, *names

    def inside(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """For the windows that begin at words `w`: first and last (exclusive) top symbol that depends on the window's
        words alone, and what was taken off in each round."""
        end = w + WINDOW
        i, j = self.run[w], self.run[end - 1]
        zero = np.uint64(0)
        taken = [
            self.words[w], np.minimum(self.run_at[i + 1], end) - w, np.where(i == j, zero, self.words[end - 1]), np.where(i == j, 0, end - self.run_at[j]),
        ]
        s, e = i + 1, np.maximum(j, i + 1)
        for symbols, left, into in self.rounds:
            last = max(len(symbols) - 1, 0)
            off = (s < e) & ~left[np.minimum(s, last)]
            taken.append(np.where(off, symbols[np.minimum(s, last)], zero))
            s = s + off
            off = (s < e) & left[e - 1]
            taken.append(np.where(off, symbols[e - 1], zero))
            e = e - off
            some = s < e
            s, e = np.where(some, into[np.minimum(s, last)], 0), np.where(some, into[e - 1] + 1, 0)
        return s, e, taken

    def names(self, w: np.ndarray) -> np.ndarray:
        """Names of windows, from what was taken off and the top symbols that stay."""
        s, e, taken = self.inside(w)
        n = len(self.symbols)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(self.symbols * _powers(_BASE, n), out=total[1:])
        out = (total[e] - total[s]) * _powers(_INVERSE, n + 1)[s] + (e - s).astype(np.uint64)
        for part in taken:
            out = mix(out * _SECOND + part.astype(np.uint64))
        return out

    def anchors(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and name of the anchor of each of the windows `w`; a place below zero is a window of its own."""
        s, e, _ = self.inside(w)
        value = self.symbols
        for k in range(1, TOGETHER):
            value = mix(value[:-1] * _SECOND + self.symbols[k:])
        value = np.append(value, ~np.uint64(0))
        least = [np.arange(len(value))]  # place of the least value of the next 1, 2, 4, 8 places, the first of equals
        while 2 ** len(least) < WINDOW:
            here, there = least[-1], least[-1][np.minimum(np.arange(len(value)) + 2 ** (len(least) - 1), len(value) - 1)]
            least.append(np.where(value[here] <= value[there], here, there))
        e = e - TOGETHER + 1
        size = e - s
        whole = size >= 1
        step = np.int64(np.log2(np.maximum(size, 1)))
        tables = np.stack(least)
        here, there = tables[step, np.where(whole, s, 0)], tables[step, np.where(whole, e - 2**step, 0)]
        place = np.where(whole, np.where(value[here] <= value[there], here, there), -1 - w)
        key = value[np.maximum(place, 0)]
        key[~whole] = mix(self.names(w[~whole]))
        return place, key


# -- Rounds -------------------------------------------------------------------------------------------------------


def _candidates(round_: int) -> list[int]:
    return [int(v) for v in mix(np.arange(SPLITS, dtype=np.uint64) + np.uint64(SPLITS * round_))]


def _counted(splits: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = _candidates(len(splits))
        total = [0] * len(more)
        for batch in slices(batches, "text", SLICE):
            parse = Parse(batch["text"], splits)
            total = [t + parse.pairs(split) for t, split in zip(total, more)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(more)), pa.int32()), pa.array(total, pa.int64())], ["split", "pairs"])

    return run


def named_rounds(docs: DataFrame) -> tuple[int, ...]:
    """The split of each round: of its candidates the one that names most pairs of the corpus."""
    splits: tuple[int, ...] = ()
    for round_ in range(COUNTED):
        pairs = docs.select("text").where("text is not null").mapInArrow(_counted(splits), "split int, pairs long")
        best = pairs.groupBy("split").agg(F.sum("pairs").alias("pairs")).orderBy(F.desc("pairs"), "split").first()
        splits += (_candidates(round_)[best["split"] if best else 0],)
    return splits


def high(splits: tuple[int, ...]) -> tuple[int, ...]:
    """The splits of all rounds; those after the counted ones are given."""
    return splits + tuple(_candidates(round_)[0] for round_ in range(len(splits), HIGH))


# -- Settle, reveal and verify --------------------------------------------------------------------------------------


def _long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def _listed(parse: Parse, places: pa.Array) -> np.ndarray:
    """The windows in a list of (pos, n) of each text."""
    each = places.flatten()
    text = np.repeat(parse.at[:-1], _long(pa.compute.fill_null(pa.compute.list_value_length(places), 0)))
    return expanded(text + _long(each.field("pos")), _long(each.field("n")).astype(np.int64))


def _ranges(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each distinct one begins in it."""
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    return order, np.flatnonzero(new)


def _least(keys: list[np.ndarray], doc: np.ndarray) -> np.ndarray:
    """For each row the least doc of the rows with equal keys."""
    order, begin = _ranges(keys)
    out = np.empty(len(doc), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(doc[order], begin), np.diff(np.append(begin, len(order))))
    return out


def _own(doc: np.ndarray, row: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """A name that spreads decided rows over tasks."""
    return mix(mix(doc.astype(np.uint64) + row.astype(np.uint64) * _FIRST) + pos.astype(np.uint64))


def _located(parse: Parse, batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    owner = parse.owner(w)
    return _long(batch["doc"])[owner], _long(batch["row"])[owner], w - parse.at[owner]


def _told(key: np.ndarray, name: np.ndarray, doc: np.ndarray, row: np.ndarray, pos: np.ndarray, n: np.ndarray, known: np.ndarray) -> pa.RecordBatch:
    """Rows of windows: those known to be in a smaller document, and those to be compared with other slices."""
    return pa.RecordBatch.from_arrays([
        pa.array(np.where(known, _own(doc, row, pos), key).view(np.int64)), pa.array(np.where(known, np.uint64(0), name).astype(np.uint32).view(np.int32)),
        pa.array(doc), pa.array(row), pa.array(pos, pa.int32()), pa.array(n, pa.int32()), pa.array(np.where(known, DECIDED, OPEN), pa.int8()),
    ], ["key", "name", "doc", "row", "pos", "n", "kind"])


TOLD = "key long, name int, doc long, row long, pos int, n int, kind byte"


def _blocks(splits: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            parse = Parse(batch["text"], splits)
            w, n, key, name = parse.blocks()
            if len(w):
                doc, row, pos = _located(parse, batch, w)
                yield _told(key, name, doc, row, pos, n, doc > _least([key, name], doc))

    return run


def _anchors(splits: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            parse = Parse(batch["text"], splits)
            open_ = np.zeros(len(parse.words), bool)
            open_[parse.windows()] = True
            open_[_listed(parse, batch["settled"])] = False
            w = np.flatnonzero(open_)
            w = w[batch["doc_id"].is_valid().to_numpy(zero_copy_only=False)[parse.owner(w)]]
            if not len(w):
                continue
            place, key = parse.anchors(w)
            first = np.ones(len(w), bool)
            first[1:] = (place[1:] != place[:-1]) | (w[1:] != w[:-1] + 1)
            at = np.flatnonzero(first)
            n, key, w = np.diff(np.append(at, len(w))), key[at], w[at]
            doc, row, pos = _located(parse, batch, w)
            order, begin = _ranges([key])
            lo, hi = np.minimum.reduceat(doc[order], begin), np.maximum.reduceat(doc[order], begin)
            many = lo != hi
            known = np.empty(len(key), bool)
            known[order] = np.repeat(many, np.diff(np.append(begin, len(order))))
            marks = key[order][begin[many]]
            none = np.zeros(2 * len(marks), np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate((np.where(known, _own(doc, row, pos), key), marks, marks)).view(np.int64)), pa.array(np.concatenate((doc, lo[many], hi[many]))),
                pa.array(np.concatenate((row, none))), pa.array(np.concatenate((pos, none)), pa.int32()), pa.array(np.concatenate((n, none)), pa.int32()),
                pa.array(np.concatenate((np.where(known, DECIDED, OPEN), none + MARK)), pa.int8()),
            ], ["key", "doc", "row", "pos", "n", "kind"])

    return run


def _windows(splits: tuple[int, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            parse = Parse(batch["text"], splits)
            w = np.sort(_listed(parse, batch["places"]))
            if not len(w):
                continue
            key, name = parse.anchors(w)[1], parse.names(w)
            doc, row, pos = _located(parse, batch, w)
            known = doc > _least([key, name], doc)
            # Decided windows that follow each other in a document are one row.
            joined = np.zeros(len(w), bool)
            joined[1:] = known[1:] & known[:-1] & (w[1:] == w[:-1] + 1) & (pos[1:] != 0)
            at = np.flatnonzero(~joined)
            yield _told(key[at], name[at], doc[at], row[at], pos[at], np.diff(np.append(at, len(w))), known[at])

    return run


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words that are left, joined by one space, with the counts and the spans of words that went."""
    for batch in slices(batches, "text", SLICE):
        counts, removed, spans, kept = [], [], [], []
        for text, cover in zip(batch["text"].cast(pa.large_binary()).to_pylist(), batch["cover"].to_pylist()):
            own = (text or b"").split()  # at ASCII white space: 0x09 to 0x0D and the space
            gone: list[list[int]] = []
            for pos, n in sorted((c["pos"], c["n"]) for c in cover or ()):
                if gone and pos <= gone[-1][1]:
                    gone[-1][1] = max(gone[-1][1], pos + n - 1 + WINDOW)
                else:
                    gone.append([pos, pos + n - 1 + WINDOW])
            counts.append(len(own))
            removed.append(sum(b - a for a, b in gone))
            spans.append([{"first": a, "end": b} for a, b in gone])
            for a, b in reversed(gone):
                del own[a:b]
            kept.append(b" ".join(own).decode())
        yield pa.RecordBatch.from_arrays([
            batch["doc_id"], pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string()),
            pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))),
        ], ["doc_id", "n_words", "n_removed", "kept", "spans"])


def _identified(docs: DataFrame) -> DataFrame:
    """(doc, row, doc_id, text): doc and row find a document, and are never null."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    content = F.xxhash64("text", F.col("text").isNull())
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(content).alias("a"), F.max(content).alias("b")).where("a <> b").select("doc_id", F.lit(True).alias("several"))
    n = several.count()
    if n:
        rows = rows.join(F.broadcast(several) if n <= BROADCAST_IDS else several, "doc_id", "left")
    else:
        rows = rows.withColumn("several", F.lit(None).cast("boolean"))
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text", F.lit("no id"))).when(F.col("several"), content).otherwise(F.lit(0))
    return rows.select(F.coalesce("doc_id", F.lit(0)).alias("doc"), F.coalesce(own, F.lit(0)).alias("row"), "doc_id", "text")


def _in_smaller(told: DataFrame) -> DataFrame:
    """(doc, row, pos, n): windows that a document of smaller id has too."""
    least = F.min("doc").over(Window.partitionBy("key", "name"))
    found = told.withColumn("lo", least).where((F.col("kind") == DECIDED) | (F.col("doc") > F.col("lo")))
    return found.select("doc", "row", "pos", "n")


def _gathered(windows: DataFrame, name: str) -> DataFrame:
    return windows.groupBy("doc", "row").agg(F.collect_list(F.struct("pos", "n")).alias(name))


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by a space) and spans (first, end: words that went)
    of every document."""
    texts, splits = _identified(docs), named_rounds(docs)

    settled = cut(_in_smaller(texts.where("doc_id is not null and text is not null").mapInArrow(_blocks(high(splits)), TOLD)))

    # No filter on texts here, so that all joins shuffle them alike, that is once.
    anchors = texts.join(_gathered(settled, "settled"), ["doc", "row"], "left").mapInArrow(_anchors(splits[:LOW]), "key long, doc long, row long, pos int, n int, kind byte")
    of_key = Window.partitionBy("key")
    seen = anchors.withColumns({"lo": F.min("doc").over(of_key), "hi": F.max("doc").over(of_key)})
    shared = seen.where((F.col("kind") == DECIDED) | (F.col("kind") == OPEN) & (F.col("lo") < F.col("hi")))

    found = _in_smaller(texts.join(_gathered(shared, "places"), ["doc", "row"]).mapInArrow(_windows(splits[:LOW]), TOLD))
    cover = _gathered(found.unionByName(settled), "cover")
    return texts.join(cover, ["doc", "row"], "left").mapInArrow(
        _kept, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<first: int, end: int>>")


def op11_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


# All windows as strings of words, for small tables.
OP11_SQL = f"""
with d as materialized (
  select row_number() over () as r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as ws from documents
), g as materialized (
  select r, doc_id, i, array_to_string(ws[i : i + {WINDOW - 1}], ' ') as g from d, unnest(range(1, len(ws) - {WINDOW - 2})) t(i)
), gone as (
  select distinct r, i + k as j from g join (select g, min(doc_id) as least from g group by g) using (g), range({WINDOW}) s(k) where least < doc_id
), w as (
  select r, unnest(ws) as word, generate_subscripts(ws, 1) as j from d
), kept as (
  select r, string_agg(word, ' ' order by j) as kept, count(*) as n from w anti join gone using (r, j) group by r
)
select doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from d left join kept using (r)
"""

"""BPE encoding and decoding through a minimal acyclic transducer of frequent words.

1. Words of the whole corpus are counted; the frequent ones are merged once and compiled into a minimal acyclic
   automaton: states with equal futures are shared, so suffixes are stored once. Each arc carries a number; the numbers
   along a word's path add up to its rank, which leads to its ids. So the automaton is a transducer from words to ids.
2. The automaton is a few flat arrays in one file in the shared folder, shipped with Spark's files and memory-mapped by
   every task; tasks on one machine share its pages, and a new executor fetches it again.
3. A word that the lexicon lacks is merged exactly, by rank, so the lexicon decides speed only, never the result.

The tokenizer file (a parameter) states the model: NFC, lower case, words by pattern, bytes as characters, merges with a
word-end mark. Its added tokens are cut out of the raw text first. Decoding joins the tokens by one space, as a model
without decoder does.

Code points that Unicode has not assigned may be classed otherwise by another Unicode version of the pattern engine.

Edge cases: a null text counts as empty and has no ids; white space alone has none; repeated rows and ties cannot differ;
an empty table gives no rows; extra columns stay in `encode`.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
import uuid
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from snapledger.llm.common import folder, slices, worker_memo

LEXICON_WORDS = 200_000
KNOWN_CHUNKS = 400_000  # texts between white space, and words, that a worker remembers, half of them the newer ones
KNOWN_LETTERS = 64  # longer ones are not remembered, so what is remembered is bounded in bytes
LONG_WORD = 48  # characters, from which on merging keeps its pairs in a heap

# Fixed values of the public model: its word pattern, and the printable stand-in of every byte.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


# Separators to Python, but not to the model.
_NOT_SPACE = regex.compile("[\x1c-\x1f]")


def chunks(text: str) -> list[str]:
    """What stands between white space. No word reaches over it, so chunks can be coded one by one, and remembered."""
    return regex.split(r"\s+", text) if _NOT_SPACE.search(text) else text.split()


def byte_characters() -> list[str]:
    """Character of each byte: itself where printable, else the next free one from 256 on."""
    out, free = {b: chr(b) for b in _PRINTABLE}, 256
    for b in range(256):
        if b not in out:
            out[b] = chr(free)
            free += 1
    return [out[b] for b in range(256)]


class Model:
    """Words and merges of one tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.vocab | self.added).items()}
        self.added_pattern = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        self.word_pattern = regex.compile(WORD)
        self.bytes = dict(enumerate(byte_characters()))
        self.texts = {i: str(i) for i in self.tokens}

    def words(self, text: str) -> list[str]:
        """Words of a text after normalisation; an added token is its own word, told apart by a leading NUL."""
        if self.added_pattern is None or "<|" not in text:
            return self._plain(text)
        out, at = [], 0
        for m in self.added_pattern.finditer(text):
            out += self._plain(text[at : m.start()])
            out.append("\0" + m.group())
            at = m.end()
        return out + self._plain(text[at:])

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            if text.isalpha():
                return [text.lower()]
            if text[-1:] in ",." and text[:-1].isalpha():
                return [text[:-1].lower(), text[-1]]
            return self.word_pattern.findall(text.lower())
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # lower case of single characters
        return self.word_pattern.findall(text.lower())

    def merged(self, word: str) -> list[int]:
        """Ids of one word by merging the best-ranked neighbours until none is left."""
        if word[0] == "\0" and word[1:] in self.added:
            return [self.added[word[1:]]]
        parts = list(word.encode().decode("latin-1").translate(self.bytes))
        parts[-1] += self.end
        if len(parts) > LONG_WORD:
            self._merge_long(parts)
            return [self.vocab[p] for p in parts if p in self.vocab]
        # One merge at a time, the leftmost of the best rank; only the ranks beside it change.
        get, none = self.ranks.get, 1 << 60
        ranks = [get(p, none) for p in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            ranks.pop(i)
            if i:
                ranks[i - 1] = get((parts[i - 1], parts[i]), none)
            if i < len(ranks):
                ranks[i] = get((parts[i], parts[i + 1]), none)
        return [self.vocab[p] for p in parts if p in self.vocab]

    def _merge_long(self, parts: list[str]) -> None:
        """The same merges, the next one from a heap of (rank, place), so time grows with n log n."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in ranks]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= n or ranks.get((parts[i], parts[j])) != rank:
                continue  # one of the two was merged meanwhile
            parts[i] += parts[j]
            parts[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := ranks.get((parts[i], parts[k]))) is not None:
                    heapq.heappush(heap, (new, i))
            if (h := before[i]) >= 0 and (new := ranks.get((parts[h], parts[i]))) is not None:
                heapq.heappush(heap, (new, h))
        parts[:] = [p for p in parts if p]

    def decode(self, ids) -> str:
        return " ".join(self.tokens[i] for i in ids)


def model_of(spec: str) -> Model:
    """The model of a tokenizer file's text; a worker reads it once."""
    memo = worker_memo("bpe", "model")
    if spec not in memo:
        memo.clear()
        memo[spec] = Model(json.loads(spec))
    return memo[spec]


def compiled(words: dict[str, list[int]]) -> bytes:
    """The minimal acyclic transducer of `words` as one block of bytes.

    Words are added in the order of their UTF-8 bytes; behind the last common prefix nothing changes any more, so its
    states are frozen and replaced by an equal one that exists. Arrays: first arc of each state; label, target and rank
    offset of each arc; first id of each rank; ids. An arc's offset counts the words its state takes before it.
    """
    keys = sorted((w.encode("utf-8", "surrogatepass"), w) for w in words)
    register: dict[tuple, int] = {}
    frozen: list[tuple] = []  # (final, ((label, target), ...))
    path: list[list] = [[False, []]]  # states of the current word: final, arcs

    def freeze(down_to: int, last: bytes) -> None:
        for depth in range(len(path) - 1, down_to, -1):
            final, arcs = path.pop()
            state = (final, tuple(arcs))
            number = register.get(state)
            if number is None:
                number = register[state] = len(frozen)
                frozen.append(state)
            path[-1][1].append((last[depth - 1], number))

    last = b""
    for key, _ in keys:
        common = 0
        while common < min(len(key), len(last)) and key[common] == last[common]:
            common += 1
        freeze(common, last)
        path.extend([False, []] for _ in range(len(key) - common))
        path[-1][0] = True
        last = key
    freeze(0, last)
    root = (path[0][0], tuple(path[0][1]))
    frozen.append(root)

    taken = [0] * len(frozen)  # words that a state accepts; targets come before their sources
    first, labels, targets, offsets = [0], [], [], []
    for i, (final, arcs) in enumerate(frozen):
        count = int(final)
        for label, target in arcs:
            labels.append(label)
            targets.append(target)
            offsets.append(count)
            count += taken[target]
        taken[i] = count
        first.append(len(labels))
    ids = [words[w] for _, w in keys]
    arrays = [
        np.array([f for f, _ in frozen], np.int32), np.array(first, np.int32), np.array(labels, np.int32),
        np.array(targets, np.int32), np.array(offsets, np.int32),
        np.cumsum([0] + [len(x) for x in ids]).astype(np.int32), np.array([i for x in ids for i in x], np.int32),
    ]
    return np.array([len(a) for a in arrays], np.int64).tobytes() + b"".join(a.tobytes() for a in arrays)


class Lexicon:
    """A compiled transducer over a memory-mapped file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        sizes, at, arrays = raw[:56].view(np.int64), 56, []
        for n in sizes:
            arrays.append(memoryview(raw[at : at + 4 * int(n)].view(np.int32)))
            at += 4 * int(n)
        self.final, self.first, self.labels, self.targets, self.offsets, self.at, self.ids = arrays

    def find(self, word: str) -> list[int] | None:
        state, rank = len(self.final) - 1, 0
        first, labels = self.first, self.labels
        for byte in word.encode("utf-8", "surrogatepass"):
            end = first[state + 1]
            arc = bisect_left(labels, byte, first[state], end)  # arcs of a state are in the order of their labels
            if arc == end or labels[arc] != byte:
                return None
            rank += self.offsets[arc]
            state = self.targets[arc]
        return list(self.ids[self.at[rank] : self.at[rank + 1]]) if self.final[state] else None


def lexicon_of(name: str) -> Lexicon:
    """The lexicon among Spark's files; a worker maps it once."""
    memo = worker_memo("bpe", "lexicon")
    if name not in memo:
        memo.clear()
        memo[name] = Lexicon(SparkFiles.get(name))
    return memo[name]


Spelling = tuple[str, str, int]  # ids and tokens joined by spaces, and how many


class Remembered:
    """Spellings that a worker keeps: newer ones, and older ones that go when the newer are many and take their place.
    What is asked for again becomes new, so the frequent ones stay."""

    def __init__(self) -> None:
        self.new: dict[str, Spelling] = {}
        self.old: dict[str, Spelling] = {}

    def put(self, text: str, spelling: Spelling) -> None:
        if len(text) <= KNOWN_LETTERS:
            self.new[text] = spelling

    def again(self, text: str) -> Spelling | None:
        found = self.old.pop(text, None)
        if found:
            self.new[text] = found
        return found

    def age(self) -> None:
        if len(self.new) >= KNOWN_CHUNKS // 2:
            self.old.clear()
            self.old.update(self.new)
            self.new.clear()


def _remembered(lexicon: str) -> tuple[Remembered, Remembered]:
    """What a worker knows of chunks and of words, for one lexicon at a time."""
    memo = worker_memo("bpe", "known")
    if lexicon not in memo:
        memo.clear()
        memo[lexicon] = (Remembered(), Remembered())
    return memo[lexicon]


def word_counts(docs: DataFrame, spec: str) -> DataFrame:
    """word, n over all documents: counted per slice in tasks, then added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(spec)
        seen: Counter = Counter()

        def words() -> pa.RecordBatch:
            out: dict[str, int] = {}
            for chunk, n in seen.items():
                for word in model.words(chunk):
                    out[word] = out.get(word, 0) + n
            seen.clear()
            return pa.record_batch([pa.array(list(out), pa.string()), pa.array(list(out.values()), pa.int64())], ["word", "n"])

        for batch in slices(batches, "text"):
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(chunks(text))
            if len(seen) > KNOWN_CHUNKS:
                yield words()
        yield words()

    counted = docs.select("text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_file(docs: DataFrame, spec: str, size: int = LEXICON_WORDS) -> str:
    """Compile the `size` most frequent words and ship the file; gives its name among Spark's files."""
    spark = docs.sparkSession
    top = word_counts(docs, spec).orderBy(F.desc("n"), "word").limit(size).select("word")

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = model_of(spec).merged
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([merged(w) for w in batch.column(0).to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    table = top.mapInArrow(spell, "word string, ids array<int>").toArrow()  # `size` rows at most
    words = dict(zip(table["word"].to_pylist(), table["ids"].to_pylist()))
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    jvm, uri = spark.sparkContext._jvm, f"{folder(spark)}/{name}"
    path = jvm.org.apache.hadoop.fs.Path(uri)
    out = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
    try:
        out.write(bytearray(compiled(words)))
    finally:
        out.close()
    spark.sparkContext.addFile(uri)
    return name


def coded(docs: DataFrame, spec: str, lexicon: str, columns: dict[str, str]) -> DataFrame:
    """`docs` with further columns of encoding its `text`.

    columns: name -> one of ids, n_tokens, ids_sha256, decoded, decoded_sha256.
    """
    kinds = {"ids": T.ArrayType(T.IntegerType()), "n_tokens": T.LongType()}
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, kinds.get(k, T.StringType())) for n, k in columns.items())])
    n_given, text_at = len(docs.columns), docs.columns.index("text")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = model_of(spec), lexicon_of(lexicon)
        known_chunks, known_words = _remembered(lexicon)
        known, seen, texts, tokens = known_chunks.new, known_words.new, model.texts, model.tokens

        def spelt(word: str) -> Spelling:
            out = known_words.again(word)
            if out is None:
                ids = words.find(word)
                if ids is None:
                    ids = model.merged(word)
                out = (" ".join([texts[i] for i in ids]), " ".join([tokens[i] for i in ids]), len(ids))
                known_words.put(word, out)
            return out

        def learn(chunk: str) -> Spelling:
            out = known_chunks.again(chunk)
            if out is None:
                parts = [p for p in [seen.get(w) or spelt(w) for w in model.words(chunk)] if p[2]]
                out = parts[0] if len(parts) == 1 else (" ".join([p[0] for p in parts]), " ".join([p[1] for p in parts]), sum([p[2] for p in parts]))
                known_chunks.put(chunk, out)
            return out

        want = set(columns.values())
        for batch in slices(batches, "text"):
            made: dict[str, list] = {k: [] for k in want}
            for text in batch.column(text_at).to_pylist():
                known_chunks.age()
                known_words.age()
                got = [known.get(c) or learn(c) for c in chunks(text or "")]
                got = [g for g in got if g[2]]
                if want & {"ids", "ids_sha256"}:
                    ids = " ".join([g[0] for g in got])
                    if "ids" in want:
                        made["ids"].append([int(i) for i in ids.split()])
                    if "ids_sha256" in want:
                        made["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                if want & {"decoded", "decoded_sha256"}:
                    decoded = " ".join([g[1] for g in got])
                    if "decoded" in want:
                        made["decoded"].append(decoded)
                    if "decoded_sha256" in want:
                        made["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if "n_tokens" in want:
                    made["n_tokens"].append(sum([g[2] for g in got]))
            arrow = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            more = [pa.array(made[k], arrow.get(k, pa.string())) for k in columns.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_given], *more], names=schema.names)

    return docs.mapInArrow(code, schema)


def encode(docs: DataFrame, tokenizer: str, columns: dict[str, str], size: int = LEXICON_WORDS) -> DataFrame:
    """`docs` encoded by the tokenizer file at `tokenizer` (a path on the driver); see `coded`."""
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    return coded(docs, spec, lexicon_file(docs, spec, size), columns)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    columns = {c: c for c in ("n_tokens", "ids_sha256", "decoded_sha256")}
    return encode(docs, tokenizer_path(), columns).drop("text")

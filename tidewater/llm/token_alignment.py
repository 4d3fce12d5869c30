"""Alignment of two tokenizers by diagonal run skipping.

Both encodings of a text are arrays of byte ends. From a common border the
arrays are compared at the current index shift in stretches of doubling length,
which jumps over runs of one-to-one tokens; the first difference is closed in
on by halving. There the irregular group is resolved token by token up to the
next common end, which gives the new shift.

Groups cut both encodings; every A token of a group is linked with every B
token of it. Tasks work on blocks of documents: a block's distinct id pairs are
listed once with the number of its documents that hold them, and its documents
refer to that list. So what is shuffled to count the pairs of the corpus is a
row per pair and block, never one per link, and a pair that every document
holds is one row per block like any other. The counts come back by block.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import record_batches, stage, workers_import

#: Text bytes in a block at most (one longer text is a block of its own).
BLOCK_BYTES = 4 << 20
#: Texts are encoded in portions of so many bytes.
ENCODE_BYTES = 1 << 20
#: A group with more links than this lists them by distinct ids.
WIDE = 4096
#: Links listed at once.
SLICE_LINKS = 1 << 20
#: A pair is one long: the A id above, the B id in so many low bits.
PAIR_BITS = 32
#: Characters whose classes are the same in all library versions.
SETTLED = regex.compile(r"[\x00-ɏ‐-‧‰-⁞€]*+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
STAGED = ("kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
          "pairs binary, times binary, at int, pair long, n_docs long")


def diagonal_groups(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For each group of two arrays of ascending ends with one last value: the
    number of tokens of both up to its end."""
    n = len(a)
    i = j = 0
    runs, of_a, of_b = [], [], []
    while i < n:
        start, step = i, 1
        while a[i:i + step] == b[j:j + step]:
            i += step
            j += step
            step += step
            if i >= n:
                break
        else:
            while step > 1:
                step >>= 1
                if a[i:i + step] == b[j:j + step]:
                    i += step
                    j += step
        if i >= n:
            runs.append(n - start)
            break
        first, second, x, y = i, j, a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        i += 1
        j += 1
        runs.append(first - start)
        of_a.append(i - first)
        of_b.append(j - second)
    # A run adds one token of each at a time, an irregular group its own numbers.
    last = np.cumsum(np.array(runs, np.int64) + 1) - 1
    size = int(last[-1]) + (len(of_a) == len(runs)) if runs else 0
    up_a, up_b = np.ones(size, np.int64), np.ones(size, np.int64)
    up_a[last[:len(of_a)]], up_b[last[:len(of_b)]] = of_a, of_b
    return np.cumsum(up_a), np.cumsum(up_b)


class TokenizerPair:
    """A byte-level BPE file of the tokenizers library (A) and a SentencePiece
    model (B), one pair per worker."""

    _loaded: dict[tuple[str, str], TokenizerPair] = {}

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = count(256)
        byte_of = {chr(c): bytes([c]) for c in plain} | {chr(next(others)): bytes([c]) for c in range(256) if c not in set(plain)}
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.bytes_a[i] = b"".join(byte_of.get(c, c.encode()) for c in piece)
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
                        for i, p in enumerate(map(self.b.id_to_piece, range(self.b.get_piece_size())))]
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.digits_a, self.digits_b = _digits(len(self.bytes_a)), _digits(len(self.bytes_b))
        self.bits_b = len(self.bytes_b).bit_length()
        self.bits = self.bits_b + len(self.bytes_a).bit_length()
        self.quick = self._quick(path_a)

    @classmethod
    def at(cls, path_a: str, path_b: str) -> TokenizerPair:
        if (path_a, path_b) not in cls._loaded:
            cls._loaded[path_a, path_b] = cls(path_a, path_b)
        return cls._loaded[path_a, path_b]

    def _quick(self, path: str):
        """The same vocabulary for the faster of the two libraries, if the file's
        merges are its ids in order; it serves texts of settled characters."""
        import tiktoken

        model = json.load(open(path))["model"]
        ids = model["vocab"]
        merged = [ids["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != list(range(256, 256 + len(merged))):
            return None
        ranks = {self.bytes_a[i]: i for i in range(256 + len(merged))}
        return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        spaced = [" " + t for t in texts]
        if self.quick is None:
            of_a = [e.ids for e in self.a.encode_batch(spaced, add_special_tokens=False)]
        else:
            of_a = [self.quick.encode_ordinary(t) if SETTLED.fullmatch(t) else self.a.encode(t, add_special_tokens=False).ids for t in spaced]
        of_b = self.b.encode(texts, num_threads=1)
        for i, t in enumerate(spaced):
            want = t.encode("utf-8", "surrogatepass")
            if len(t) == 1 or b"".join(map(self.bytes_a.__getitem__, of_a[i])) != want or b"".join(map(self.bytes_b.__getitem__, of_b[i])) != want:
                of_a[i], of_b[i] = [], []
        return of_a, of_b


def _digits(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of decimal digits of the numbers below n, right-aligned, with room
    for a separator; and which places are used."""
    width = len(str(max(n - 1, 0)))
    number = np.arange(n)[:, None] // 10 ** np.arange(width - 1, -1, -1)
    cells = np.concatenate([(number % 10 + 48).astype(np.uint8), np.zeros((n, 1), np.uint8)], axis=1)
    used = np.concatenate([number > 0, np.ones((n, 1), bool)], axis=1)
    used[:, width - 1] = True
    return cells, used


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers in the narrowest type, whose size comes first."""
    kind = np.min_scalar_type(int(values.max(initial=0)))
    return bytes([kind.itemsize]) + values.astype(kind).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


class Block:
    """The aligned documents of one block, as flat arrays."""

    def __init__(self, pair: TokenizerPair):
        self.pair, self.ids, self.size = pair, [], 0
        self.a, self.b, self.ends_a, self.ends_b = [], [], [], []

    def add(self, ids: list, texts: list[str]) -> None:
        for doc_id, a, b in zip(ids, *self.pair.encode(texts), strict=True):
            a, b = np.array(a, np.int32), np.array(b, np.int32)
            ends = [np.cumsum(n[x]).tolist() for n, x in ((self.pair.length_a, a), (self.pair.length_b, b))]
            in_a, in_b = diagonal_groups(*ends)
            self.ids.append(doc_id)
            self.a.append(a)
            self.b.append(b)
            self.ends_a.append(in_a)
            self.ends_b.append(in_b)

    def _digests(self, a, b, first_a, first_b, n_a, n_b, groups_of) -> list[str]:
        """sha256 of `a1,a2|b1;...` per document."""
        group_a, group_b = np.repeat(np.arange(len(n_a)), n_a), np.repeat(np.arange(len(n_b)), n_b)
        place_a = np.arange(len(a)) + first_b[group_a]
        place_b = np.arange(len(b)) + (first_a + n_a)[group_b]
        width = max(self.pair.digits_a[0].shape[1], self.pair.digits_b[0].shape[1])
        cells, used = np.zeros((len(a) + len(b), width), np.uint8), np.zeros((len(a) + len(b), width), bool)
        for ids, place, (digits, is_used), first, n, mark in ((a, place_a, self.pair.digits_a, first_a, n_a, "|"), (b, place_b, self.pair.digits_b, first_b, n_b, ";")):
            at = width - digits.shape[1]
            rows, flags = digits[ids], is_used[ids]
            rows[:, -1] = ord(",")
            rows[first + n - 1, -1] = ord(mark)
            cells[place, at:], used[place, at:] = rows, flags
        text = cells[used].tobytes()
        upto = np.concatenate([[0], np.cumsum(used.sum(axis=1))])
        borders = upto[np.concatenate([[0], np.cumsum([n for n, _ in groups_of])])].tolist()
        # The last group's mark is left out.
        return [hashlib.sha256(text[x:y - 1]).hexdigest() if y > x else "" for x, y in zip(borders, borders[1:])]

    def _links(self, a, b, first_a, first_b, n_a, n_b, doc) -> tuple[np.ndarray, np.ndarray]:
        """Keys of (document, A id, B id) in ascending order, and how often each
        is linked. Wide groups count distinct ids; others list their links, some
        groups at a time."""
        keys, times = [], []
        bits, bits_b = self.pair.bits, self.pair.bits_b

        size = n_a * n_b
        narrow = np.flatnonzero(size <= WIDE)
        upto = np.cumsum(size[narrow])
        at = 0
        while at < len(narrow):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE_LINKS, "right")))
            g = narrow[at:end]
            which = np.repeat(np.arange(len(g)), size[g])
            inner = np.arange(len(which)) - np.repeat(np.cumsum(size[g]) - size[g], size[g])
            g = g[which]
            x, y = np.divmod(inner, n_b[g])
            key, n = np.unique((doc[g] << bits) | (a[first_a[g] + x].astype(np.int64) << bits_b) | b[first_b[g] + y], return_counts=True)
            keys.append(key)
            times.append(n)
            at = end
        for g in np.flatnonzero(size > WIDE).tolist():
            xs, nx = np.unique(a[first_a[g]:first_a[g] + n_a[g]], return_counts=True)
            ys, ny = np.unique(b[first_b[g]:first_b[g] + n_b[g]], return_counts=True)
            keys.append(((int(doc[g]) << bits) | (xs.astype(np.int64)[:, None] << bits_b) | ys[None, :]).ravel())
            times.append((nx[:, None] * ny[None, :]).ravel())
        if not keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # A document's pair may come from several slices: add them up.
        key, n = np.concatenate(keys), np.concatenate(times)
        order = np.argsort(key, kind="stable")
        key, n = key[order], n[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        return key[head], np.add.reduceat(n, head) if len(head) else n

    def flush(self, block: int) -> Iterator[pa.RecordBatch]:
        groups_of = [(len(a) + len(b), len(g)) for a, b, g in zip(self.a, self.b, self.ends_a, strict=True)]
        a, b = np.concatenate(self.a), np.concatenate(self.b)
        n_a, n_b = (np.concatenate([np.diff(x, prepend=0) for x in ends]).astype(np.int64) for ends in (self.ends_a, self.ends_b))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        doc = np.repeat(np.arange(len(self.ids)), [n for _, n in groups_of])
        digests = self._digests(a, b, first_a, first_b, n_a, n_b, groups_of)
        key, times = self._links(a, b, first_a, first_b, n_a, n_b, doc)
        pairs, at = np.unique(key & ((1 << self.pair.bits) - 1), return_inverse=True)
        of_doc = np.searchsorted(key >> self.pair.bits, np.arange(len(self.ids) + 1))
        links = np.concatenate([[0], np.cumsum(n_a * n_b)])[np.concatenate([[0], np.cumsum([n for _, n in groups_of])])]
        # A document's pairs ascend: their steps are small numbers.
        spans = list(zip(of_doc.tolist(), of_doc[1:].tolist(), strict=False))
        rows = {"doc_id": self.ids, "n_a": list(map(len, self.a)), "n_b": list(map(len, self.b)), "n_groups": [n for _, n in groups_of], "n_links": np.diff(links),
                "groups_sha256": digests, "pairs": [packed(np.diff(at[x:y], prepend=0)) for x, y in spans], "times": [packed(times[x:y]) for x, y in spans]}
        yield _staged(len(self.ids), kind=0, block=block, **rows)
        step = 1 << 16
        n_docs = np.bincount(at, minlength=len(pairs))
        for x in range(0, len(pairs), step):
            part = pairs[x:x + step]
            part = (part >> self.pair.bits_b << PAIR_BITS) | (part & ((1 << self.pair.bits_b) - 1))
            yield _staged(len(part), kind=1, block=block, at=np.arange(x, x + len(part)), pair=part, n_docs=n_docs[x:x + step])


_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in STAGED.split(", "))])


def _staged(rows: int, **columns) -> pa.RecordBatch:
    def column(field: pa.Field) -> pa.Array:
        value = columns.get(field.name)
        if value is None or isinstance(value, int):
            return pa.array(np.full(rows, value), field.type) if value is not None else pa.nulls(rows, field.type)
        return pa.array(value, field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in SCHEMA], schema=SCHEMA)


def _aligned(path_a: str, path_b: str, block_bytes: int):
    def run(batches):
        pair = TokenizerPair.at(path_a, path_b)
        numbers = count(TaskContext.get().partitionId() << 24)
        block = Block(pair)
        for batch in record_batches(batches, "text", ENCODE_BYTES):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            size = pa.compute.sum(pa.compute.binary_length(batch.column("text"))).as_py() or 0
            if block.ids and block.size + size > block_bytes:
                yield from block.flush(next(numbers))
                block = Block(pair)
            block.add(batch.column("doc_id").to_pylist(), texts)
            block.size += size
        if block.ids:
            yield from block.flush(next(numbers))

    return run


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
RESULT_ARROW = pa.schema([(name, _ARROW[kind]) for name, kind in (x.split(" ") for x in RESULT.split(", "))])


def _weighed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A block's documents with the corpus-wide counts of its pairs."""
    at = pairs.column("at").to_numpy()
    counts, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    counts[at] = pairs.column("n").to_numpy()
    best[at] = pairs.column("best").to_numpy()
    n_best, count_sum = [], []
    for steps, n in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
        which, times = np.cumsum(unpacked(steps)), unpacked(n)
        n_best.append(int(times[best[which]].sum()))
        count_sum.append(int((times * counts[which]).sum()))
    columns = {name: docs.column(name) for name in RESULT_ARROW.names if name in docs.column_names}
    columns |= {"n_best": pa.array(n_best, pa.int64()), "count_sum": pa.array(count_sum, pa.int64())}
    return pa.table([columns[name] for name in RESULT_ARROW.names], schema=RESULT_ARROW)


def _weighed_pairs(listed: DataFrame) -> DataFrame:
    """(a, pair, n, best) of the corpus from the blocks' lists. The highest
    counts are one row per A id, which the vocabulary's size bounds."""
    counts = stage(listed.groupBy("pair").agg(F.sum("n_docs").alias("n")), "pair-counts").withColumn("a", F.shiftright("pair", PAIR_BITS))
    highest = counts.groupBy("a").agg(F.max("n").alias("most"))
    return counts.join(F.broadcast(highest), "a").select("a", "pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    for every row of ``docs``.

    A encodes a blank and the text, B the text, whose model adds the blank;
    special tokens spelled in a text are plain text. Null and empty texts, and
    texts whose tokens do not spell them again (such as ones with the blank's
    sign of B), have no tokens: zeros and an empty digest. A pair's count is the
    number of rows that hold it linked; repeated rows count and come back each.
    Null identifiers are kept. An empty table gives no rows; other columns are
    ignored.
    """
    workers_import(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    staged = stage(narrow.mapInArrow(_aligned(path_a, path_b, block_bytes), STAGED), "alignment")
    aligned = staged.where("kind = 0").select("block", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times")
    listed = staged.where("kind = 1").select(F.col("block").alias("of_block"), "at", "pair", "n_docs")
    weights = listed.select("of_block", "at", "pair").join(_weighed_pairs(listed).select("pair", "n", "best"), "pair").select("of_block", "at", "n", "best")
    return aligned.groupBy("block").cogroup(weights.groupBy("of_block")).applyInArrow(_weighed, RESULT)


def pair_table(docs: DataFrame, path_a: str, path_b: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(a, b, n, best): every linked id pair of the corpus, how many rows hold
    it, and whether no other B id has more with this A id."""
    workers_import(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    staged = stage(narrow.mapInArrow(_aligned(path_a, path_b, block_bytes), STAGED), "alignment")
    found = _weighed_pairs(staged.where("kind = 1").select("pair", "n_docs"))
    return found.select("a", F.col("pair").bitwiseAND(F.lit((1 << PAIR_BITS) - 1)).alias("b"), "n", "best")

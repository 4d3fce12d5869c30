"""Token counts without token ids.

Documents are cut into pre-tokens and counted once per document. Pre-tokens
that are vocabulary entries themselves (bounded by the tokenizer's vocabulary,
which every worker holds anyway) are counted on the spot; the open-ended rest
goes through a join: postings per pre-token and block of documents meet a table
that counts the pieces of each distinct pre-token once. The sum per document is
a grouped aggregation. Ids are never made.

Postings hold row numbers inside a block of the scan, so the input must be read
in the same order again after a lost executor: a table scan, or a written stage.
"""

from __future__ import annotations

from collections import Counter
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import record_batches, workers_import

#: Salt of pre-tokens that have this many postings in one block.
HOT_POSTINGS = 512
SALTS = 256
#: Text bytes in a block at most (one longer text is a block of its own).
BLOCK_BYTES = 24 << 20
#: Rows in a block at most, so that a posting takes two bytes.
BLOCK_ROWS = 1 << 15
HEADER = ""

#: Text in which Unicode's letters, numbers and spaces are the same in all
#: library versions; other texts are cut by the tokenizer's own pre-tokenizer.
SETTLED = regex.compile(r"[\x00-ɏ‐-‧‰-⁞€]*+")
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: A blank before a character that isn't white space always begins a pre-token,
#: unless the text has other white space next to a blank.
UNEVEN = regex.compile(r" \s|^ | $")


class PieceCounter:
    """A byte-level BPE file of the tokenizers library, one per worker."""

    _loaded: dict[str, PieceCounter] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        to_text = {c: b for b, c in _byte_letters().items()}
        self.whole: dict[str, int] = {}
        for piece in vocabulary:
            try:
                text = bytes(to_text[c] for c in piece).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if len(self._cut(text)) == 1:
                self.whole[text] = len(self.tokenizer.model.tokenize(piece))
        self.letters = [_byte_letters()[b] for b in range(256)]
        self.chunks: dict[str, tuple[str, ...]] = {}

    @classmethod
    def at(cls, path: str) -> PieceCounter:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def pieces(self, pre_token: str) -> int:
        letters = self.letters
        return len(self.tokenizer.model.tokenize("".join([letters[b] for b in pre_token.encode("utf-8")])))

    def _cut(self, text: str) -> list[str]:
        if SETTLED.fullmatch(text):
            return PATTERN.findall(text)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def frequencies(self, text: str) -> tuple[Counter, int]:
        """Pre-token frequencies, and how many special tokens the text spells."""
        special = 0
        parts = [text]
        for token in self.special:
            split = [x for part in parts for x in part.split(token)]
            special += len(split) - len(parts)
            parts = split
        found: Counter = Counter()
        for part in parts:
            if UNEVEN.search(part):
                found.update(self._cut(part))
            else:
                first, *rest = part.split(" ")
                chunks = Counter(rest)
                for chunk, n in chunks.items():
                    for pre_token in self._chunk(chunk):
                        found[pre_token] += n
                found.update(self._cut(first))
        return found, special

    def _chunk(self, chunk: str) -> tuple[str, ...]:
        """The pre-tokens of a blank and what follows it up to the next one."""
        cut = self.chunks.get(chunk)
        if cut is None:
            cut = tuple(self._cut(" " + chunk))
            if len(self.chunks) >= 400_000:  # a cache: cleared, never outgrown
                self.chunks.clear()
            if len(chunk) <= 64:
                self.chunks[chunk] = cut
        return cut


def _byte_letters() -> dict[int, str]:
    """Byte-level BPE writes each byte as a printable letter: printable Latin-1
    bytes as themselves, the others as letters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = count(256)
    return {b: chr(b) if b in set(plain) else chr(next(others)) for b in range(256)}


POSTINGS = "pre_token string, salt int, block long, rows array<smallint>, header array<struct<row:smallint,doc_id:long,n_bytes:long,n_whole:long>>"


def _postings(model_path: str, block_bytes: int):
    schema = pa.schema([("pre_token", pa.string()), ("salt", pa.int32()), ("block", pa.int64()), ("rows", pa.list_(pa.int16())),
                        ("header", pa.list_(pa.struct([("row", pa.int16()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_whole", pa.int64())])))])

    def flush(block: int, header: list, tokens: dict, ids: list, rows: list):
        at, row = np.fromiter(ids, np.int32, len(ids)), np.fromiter(rows, np.int16, len(rows))
        order = np.argsort(at, kind="stable")
        bounds = np.searchsorted(at[order], np.arange(len(tokens) + 1)).astype(np.int32)
        size = np.diff(bounds)
        salt = np.where(size >= HOT_POSTINGS, block % SALTS, 0).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(row[order]))
        none = pa.nulls(len(tokens), schema.field("header").type)
        yield pa.RecordBatch.from_arrays([pa.array(list(tokens), pa.string()), pa.array(salt), pa.array(np.full(len(tokens), block, np.int64)), lists, none], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([HEADER]), pa.array([block % SALTS], pa.int32()), pa.array([block], pa.int64()),
                                          pa.array([[]], schema.field("rows").type), pa.array([header], schema.field("header").type)], schema=schema)

    def run(batches):
        counter = PieceCounter.at(model_path)
        whole = counter.whole
        numbers = count(TaskContext.get().partitionId() << 24)
        header, tokens, ids, rows, size = [], {}, [], [], 0
        for batch in record_batches(batches, "text", block_bytes):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                text = text or ""
                n_bytes = len(text.encode("utf-8"))
                if header and (size + n_bytes > block_bytes or len(header) == BLOCK_ROWS):
                    yield from flush(next(numbers), header, tokens, ids, rows)
                    header, tokens, ids, rows, size = [], {}, [], [], 0
                size += n_bytes
                found, n = counter.frequencies(text)
                row = len(header)
                for token, times in found.items():
                    known = whole.get(token)
                    if known is None:
                        at = tokens.setdefault(token, len(tokens))
                        if times == 1:
                            ids.append(at)
                            rows.append(row)
                        else:
                            ids.extend([at] * times)
                            rows.extend([row] * times)
                    else:
                        n += known * times
                header.append((row, doc_id, n_bytes, n))
        if header:
            yield from flush(next(numbers), header, tokens, ids, rows)

    return run


def count_tokens(docs: DataFrame, model_path: str, limit: int = 1024, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of ``docs``.

    The counts are those of the tokenizer file's library without begin, end or
    added tokens; a special token spelled in a text counts as one. Null text is
    empty: no bytes, no tokens. Repeated rows repeat; an empty table gives no
    rows; other columns are ignored.
    """
    workers_import(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    # One exchange serves both sides of the join; a hot pre-token is salted by block.
    posted = narrow.mapInArrow(_postings(model_path, block_bytes), POSTINGS).repartition("pre_token", "salt")

    @F.pandas_udf("int")
    def pieces(tokens: pd.Series) -> pd.Series:
        counter = PieceCounter.at(model_path)
        return tokens.map(lambda t: counter.pieces(t) if t else 0).astype("int32")

    # Reading all columns keeps this exchange equal to the postings' own, so Spark runs it once.
    distinct = (posted.groupBy("pre_token", "salt").agg(F.max("block").alias("last"), F.sum(F.size("rows")).alias("times"), F.sum(F.size("header")).alias("headers"))
                .where("times + coalesce(headers, 0) <> 0 AND last >= 0"))
    counted = distinct.select("pre_token", "salt", pieces("pre_token").alias("n"))
    joined = posted.join(counted, ["pre_token", "salt"])
    # Row numbers of all blocks: block and row in one long.
    entry = "struct<row:smallint,doc_id:long,n_bytes:long,n:long>"
    none = F.lit(None).cast("long")
    tail = F.transform("rows", lambda r: F.struct(r, none, none, F.col("n").cast("long")).cast(entry))
    head = F.coalesce(F.col("header").cast(f"array<{entry}>"), F.array().cast(f"array<{entry}>"))
    parts = joined.select("block", F.explode(F.concat(tail, head)).alias("e"))
    parts = parts.select((F.col("block") * BLOCK_ROWS + F.col("e.row")).alias("row"), "e.doc_id", "e.n_bytes", "e.n")
    sums = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
    return sums.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

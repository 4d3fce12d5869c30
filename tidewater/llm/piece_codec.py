"""SentencePiece encoding and decoding with a batched numpy forward pass.

All distinct words of a batch are encoded together, words of equal length
advancing in step. At each end position every piece length is tried: prefix
hashes give the substring's hash, which is searched in the sorted hashes of the
pieces; the best candidate's length is stored as the backpointer, and walking
these back gives the pieces.

The model at hand is a BPE model, whose scores are merge ranks. A path of the
largest score sum is not what its library returns, so a candidate scores only
if it can follow the piece chosen before it: merging the pair's text must give
that pair again. Exactly one candidate per position does, so the maximum is the
library's own segmentation (a BPE encoding is valid if all neighbours are).
Bytes stand for characters without a piece.

Long stretches without blanks are cut before they are encoded. Two characters
that stand side by side in no piece are never merged, so they are a border:
nearly every one is in Chinese or Japanese. What is longer still (base64, runs
of one letter) is encoded in overlapping windows of equal length that advance
together; neighbours are joined at an end that both have and where the two
pieces can stand side by side, which makes the whole valid and so the library's.
A window without such an end goes on from the last one that is settled.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewater.llm.common import record_batches, workers_import

SPACE_PIECE = "▁"
BASE = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(f"{SPACE_PIECE}[^{SPACE_PIECE}]*")
#: Words that a worker remembers between batches.
CACHE_WORDS = 300_000
#: Words over so many characters are cut at borders that no piece crosses.
LONG_WORD = 24
LONG = re.compile(f"[^{SPACE_PIECE}]{{{LONG_WORD}}}")
#: Stretches over two windows are encoded in windows, each this far after the one before.
WINDOW, STRIDE = 192, 128
#: Bits of the table of pairs.
PAIR_TABLE = 21
PAD, PAD_STEP = chr(0x10FFFF), 16
#: Words over so many characters are not kept between batches.
CACHED_WORD = 64
BATCH_BYTES = 8 << 20


def _mixed(codes: np.ndarray) -> np.ndarray:
    """Characters as 64-bit values without small-number structure."""
    x = codes.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(29))) * BASE


class PieceModel:
    """The normal pieces of a SentencePiece BPE model as sorted hash keys."""

    _loaded: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.texts = [sp.id_to_piece(i) for i in range(size)]
        self.kinds = ["byte" if sp.is_byte(i) else "none" if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) else "text" for i in range(size)]
        self.byte_ids = np.zeros(256, np.int32)
        for i, kind in enumerate(self.kinds):
            if kind == "byte":
                self.byte_ids[int(self.texts[i][1:-1], 16)] = i
        ids = [i for i, kind in enumerate(self.kinds) if kind == "text"]
        # A run of blanks merges only with itself, after everything else; see blanks().
        self.id_of = {self.texts[i]: i for i in ids}
        inner = [i for i in ids if len(self.texts[i]) == 1 or self.texts[i].strip(SPACE_PIECE)]
        # Ranks: single characters first, then merged pieces by score (the order of merging).
        inner.sort(key=lambda i: (len(self.texts[i]) > 1, -sp.get_score(i), i))
        self.rank_ids = np.array(inner + [-1], "<i4")  # the last rank: a character without a piece
        self.n = len(inner)
        rank = {self.texts[i]: r for r, i in enumerate(inner)}
        self.longest = max(len(self.texts[i]) for i in inner)
        self.powers = BASE ** np.arange(self.longest + 1, dtype=np.uint64)
        keys = np.array([self._hash(self.texts[i]) for i in inner], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_rank = keys[order], order.astype(np.int32)
        self.likely = np.zeros(1 << 20, bool)
        self.likely[self.keys >> np.uint64(44)] = True
        self.key_length = np.array([len(self.texts[i]) for i in inner], np.int32)[order]
        # The last merge inside each piece, and the rank of every pair's merge.
        self.left, self.right = np.arange(self.n + 1, dtype=np.int64), np.arange(self.n + 1, dtype=np.int64)
        pairs: dict[int, int] = {}
        for text, r in rank.items():
            found = [(rank[text[:k]], rank[text[k:]]) for k in range(1, len(text)) if text[:k] in rank and text[k:] in rank]
            for a, b in found:
                pairs[a * (self.n + 1) + b] = r
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_rank = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        for text, r in sorted(rank.items(), key=lambda x: x[1]):
            if len(text) > 1:
                a, b = self._last_merge(text, rank)
                self.left[r], self.right[r] = a, b
        # Characters that stand side by side in some piece, as first * 2^21 + second.
        beside = {(ord(x) << 21) | ord(y) for t in rank for x, y in zip(t, t[1:])}
        self.beside = np.array(sorted(beside), np.int64)
        self.rank_of = np.full(size, self.n, np.int64)
        self.rank_of[inner] = np.arange(self.n)
        self.size_of = np.array([len(t) if k == "text" else 0 for t, k in zip(self.texts, self.kinds, strict=True)], np.int64)
        self.windows: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        self.words: dict[str, bytes] = {}  # little-endian ids
        self.pair_known = np.zeros(1 << PAIR_TABLE, np.int64)  # (pair + 1) * 2 + answer
        self.lone = np.array([self.id_of[SPACE_PIECE]], "<i4").tobytes()
        self.spelled = [bytes([int(t[1:-1], 16)]) if kind == "byte" else t.replace(SPACE_PIECE, " ").encode() if kind == "text" else b""
                        for t, kind in zip(self.texts, self.kinds, strict=True)]
        self.runs: dict[int, list[int]] = {0: [], 1: [self.id_of[SPACE_PIECE]]}

    @classmethod
    def at(cls, path: str) -> PieceModel:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _hash(self, text: str) -> np.uint64:
        codes = _mixed(np.array([ord(c) for c in text]))
        h = np.uint64(0)
        with np.errstate(over="ignore"):
            for c in codes:
                h = h * BASE + c
        return h

    def _last_merge(self, text: str, rank: dict[str, int]) -> tuple[int, int]:
        """Merge the characters of a piece by rank; its last two parts."""
        parts = list(text)
        while len(parts) > 2:
            best = min(((rank.get(a + b, self.n), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=None)
            if best[0] >= self.n:
                break
            parts[best[1]:best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(parts) != 2:  # a piece that merging never builds: it can't be chosen
            r = rank[text]
            return r, r
        return rank[parts[0]], rank[parts[1]]

    def _pair_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * (self.n + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_rank[at], self.n + 1)

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether piece b can follow piece a: undo the later of the two pieces'
        merges step by step; a merge across the border that came before an
        undone one would have taken the pair apart. Answers are kept in a table
        of fixed size by the pair's hash, a new pair takes an old one's place."""
        keys = a.astype(np.int64) * (self.n + 1) + b
        with np.errstate(over="ignore"):
            at = ((keys.astype(np.uint64) * BASE) >> np.uint64(64 - PAIR_TABLE)).astype(np.int64)
        known = self.pair_known[at]
        out = (known & 1).astype(bool)
        new = np.flatnonzero(known >> 1 != keys + 1)
        if len(new):
            fresh, back = np.unique(keys[new], return_inverse=True)
            ok = self._survives(fresh // (self.n + 1), fresh % (self.n + 1))[back]
            out[new] = ok
            self.pair_known[at[new]] = ((keys[new] + 1) << 1) | ok
        return out

    def _survives(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        ok = np.ones(len(a), bool)
        live = np.flatnonzero((a < self.n) & (b < self.n))  # nothing merges with a character without a piece
        x, y = a[live].copy(), b[live].copy()
        limit = np.full(len(live), self.n + 1, np.int64)
        while len(live):
            merged = self._pair_rank(x, y) < limit
            ok[live[merged]] = False
            go = ~merged
            live, x, y, limit = live[go], x[go], y[go], limit[go]
            # Undo the later piece; a character can't be undone, then the other one is.
            first = x > y
            done = (self.right[x] == x) & (self.left[y] == y)
            undo_x = np.where(first, self.right[x] != x, (self.left[y] == y) & (self.right[x] != x))
            # An undone left piece hides merges of its own rank or later; a right one those later than it.
            limit = np.where(undo_x, x, y + 1)
            x, y = np.where(undo_x, self.right[x], x), np.where(undo_x, y, self.left[y])
            live, x, y, limit = live[~done], x[~done], y[~done], limit[~done]
        return ok

    def parts(self, word: str) -> list[str]:
        """A long word cut wherever two characters stand side by side in no piece."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = (codes[:-1] << 21) | codes[1:]
        at = np.minimum(np.searchsorted(self.beside, pairs), len(self.beside) - 1)
        borders = [0, *(np.flatnonzero(self.beside[at] != pairs) + 1).tolist(), len(word)]
        return [word[x:y] for x, y in zip(borders, borders[1:])]

    def segment(self, words: list[str]) -> list[bytes]:
        """Little-endian ids of words of any lengths, equal lengths together, long
        ones in windows."""
        out = [b""] * len(words)
        lengths = np.array([len(w) for w in words])
        for i in np.flatnonzero(lengths > 2 * WINDOW).tolist():
            out[i] = self._in_windows(words[i])
        lengths[lengths > 2 * WINDOW] = 1 << 40
        # Lengths over LONG_WORD are padded up to the next step, so that few groups remain.
        lengths = np.where(lengths > LONG_WORD, -(-lengths // PAD_STEP) * PAD_STEP, lengths)
        for length in np.unique(lengths[lengths <= 2 * WINDOW]):
            which = np.flatnonzero(lengths == length)
            step = max(1, 2_000_000 // int(length))
            for at in range(0, len(which), step):
                part = which[at:at + step]
                for i, ids in zip(part.tolist(), self._equal(int(length), [words[i] for i in part.tolist()]), strict=True):
                    out[i] = ids
        return out

    def _equal(self, length: int, words: list[str]) -> list[bytes]:
        """Little-endian ids of words of one length, or shorter ones padded with a character
        that no piece holds, whose ranks are dropped again."""
        codes = np.frombuffer("".join([w.ljust(length, PAD) for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)
        with np.errstate(over="ignore"):
            mixed = _mixed(codes)
            prefix = np.zeros((length + 1, len(words)), np.uint64)
            for i in range(length):
                prefix[i + 1] = prefix[i] * BASE + mixed[:, i]
            # last[e]: the piece that ends the encoding of the first e characters; back[e]: its length.
            last = np.full((length + 1, len(words)), -1, np.int64)
            back = np.zeros((length + 1, len(words)), np.int32)
            for end in range(1, length + 1):
                best = np.full(len(words), -1, np.int64)
                for size in range(1, min(self.longest, end) + 1):
                    key = prefix[end] - prefix[end - size] * self.powers[size]
                    # Most substrings are no pieces: one table look-up spares them the search.
                    some = np.flatnonzero(self.likely[key >> np.uint64(44)])
                    at = np.minimum(np.searchsorted(self.keys, key[some]), self.n - 1)
                    hit = (self.keys[at] == key[some]) & (self.key_length[at] == size)
                    some, rank = some[hit], self.key_rank[at[hit]].astype(np.int64)
                    if size == 1 and len(some) < len(words):  # the others are characters without a piece
                        ranks = np.full(len(words), self.n, np.int64)
                        ranks[some] = rank
                        some, rank = np.arange(len(words)), ranks
                    if end > size and len(some):
                        before = last[end - size][some]
                        fits = before >= 0
                        fits[fits] = self.follows(before[fits], rank[fits])
                        some, rank = some[fits], rank[fits]
                    # Vectorised maximum over sizes: a valid candidate scores its size, others nothing.
                    better = size > best[some]
                    some, rank = some[better], rank[better]
                    best[some] = size
                    last[end][some], back[end][some] = rank, size
        at = np.full(len(words), length)
        rows = np.arange(len(words))
        steps = []
        while at.max(initial=0) > 0:
            live = at > 0
            steps.append(np.where(live, last[at, rows], -1))
            at = np.where(live, at - back[at, rows], 0)
        chosen = np.array(steps[::-1]).T if steps else np.empty((len(words), 0), np.int64)
        sizes = np.array([len(w) for w in words])
        # The last pieces of a padded word are its padding, one each.
        used = chosen >= 0
        used &= np.cumsum(used, axis=1) <= (used.sum(axis=1) - (length - sizes))[:, None]
        flat = self.rank_ids[chosen[used]].tobytes()
        ends = (4 * np.cumsum(used.sum(axis=1))).tolist()
        out = [flat[x:y] for x, y in zip([0, *ends], ends)]
        for i in np.flatnonzero((used & (chosen == self.n)).any(axis=1)).tolist():
            out[i] = self._with_bytes(words[i], chosen[i][used[i]])
        return out

    def _ended(self, window: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ranks and ends (in characters) of a window's pieces. The bytes of a
        character without a piece count as one rank, ``self.n``."""
        ids = np.frombuffer(window, "<i4")
        # A character's first byte tells that it begins; bytes that follow add nothing.
        value = np.full(len(self.texts), -1, np.int64)
        value[self.byte_ids] = np.arange(256)
        byte = value[ids]
        follows = (byte >= 0x80) & (byte < 0xC0)
        sizes = np.where(byte >= 0, 1, self.size_of[ids])[~follows]
        return self.rank_of[ids][~follows], np.cumsum(sizes)

    def _in_windows(self, word: str) -> bytes:
        """A long stretch: all windows at once, then joined from the left."""
        starts = list(range(0, max(1, len(word) - WINDOW + STRIDE), STRIDE))
        texts = [word[x:x + WINDOW] for x in starts]
        fresh = list(dict.fromkeys(texts))
        known = {t: self._ended(ids) for t, ids in zip(fresh, self.segment(fresh), strict=True)}
        ranks, done, at = [], 0, 0  # the pieces so far end at ``done``; the current window is ``at``
        current, base = known[texts[0]], 0
        while True:
            own, ends = current[0], current[1] + base
            first = int(np.searchsorted(ends, done, "right"))
            if ends[-1] == len(word):
                ranks.append(own[first:])
                break
            # The next window begins inside this one: common ends, then pieces that fit side by side.
            while at + 1 < len(starts) and starts[at + 1] <= done:
                at += 1
            joined = False
            if at + 1 < len(starts) and starts[at + 1] < ends[-1]:
                later, later_ends = known[texts[at + 1]]
                shared = np.intersect1d(ends[first:], np.concatenate([[0], later_ends]) + starts[at + 1])
                # The last pieces of a window may change with what follows it.
                shared = shared[(shared < ends[-1]) & (shared > done)]
                left = own[np.searchsorted(ends, shared)]
                right_at = np.searchsorted(later_ends + starts[at + 1], shared, "right")
                shared, left, right_at = (x[right_at < len(later)] for x in (shared, left, right_at))
                fits = np.flatnonzero(self.follows(left, later[right_at])) if len(shared) else []
                if len(fits):
                    end = int(shared[fits[-1]])
                    ranks.append(own[first:int(np.searchsorted(ends, end)) + 1])
                    done, at, joined = end, at + 1, True
                    current, base = known[texts[at]], starts[at]
            if not joined:
                # Go on from a piece of this window that its successor leaves alone, with ever wider windows if need be.
                step, width = self._onward(word, own, ends, first, done)
                ranks.append(step[0])
                done, current, base = step[1], width[0], width[1]
        chosen = np.concatenate(ranks)
        return self._with_bytes(word, chosen) if (chosen == self.n).any() else self.rank_ids[chosen].tobytes()

    def _onward(self, word: str, own: np.ndarray, ends: np.ndarray, first: int, done: int):
        """Settle pieces of this window up to an end from which a window that
        begins there goes on validly; (pieces, end), (window, its start)."""
        width = WINDOW
        while True:
            for back in range(len(ends) - 2, first - 1, -1):
                start = int(ends[back])
                if start <= done or ends[-1] - start < min(self.longest, WINDOW // 4):
                    continue
                found = self._window(word[start:start + width])
                if self.follows(own[back:back + 1], found[0][:1])[0]:
                    return (own[first:back + 1], start), (found, start)
            # No end of this window serves: encode it anew, twice as wide.
            width *= 2
            found = self._window(word[done:done + width], cached=False)
            own, ends, first = found[0], found[1] + done, 0
            if done + width >= len(word):
                return (own[:0], done), (found, done)

    def _window(self, text: str, cached: bool = True) -> tuple[np.ndarray, np.ndarray]:
        found = self.windows.get(text)
        if found is None:
            found = self._ended(self._equal(len(text), [text])[0])
            if cached:
                if len(self.windows) > 4096:  # a cache: cleared, never outgrown
                    self.windows.clear()
                self.windows[text] = found
        return found

    def _with_bytes(self, word: str, ranks: np.ndarray) -> bytes:
        ids, at = [], 0
        for r in ranks.tolist():
            if r == self.n:
                ids.extend(self.byte_ids[list(word[at].encode("utf-8", "surrogatepass"))].tolist())
                at += 1
            else:
                i = int(self.rank_ids[r])
                ids.append(i)
                at += len(self.texts[i])
        return np.array(ids, "<i4").tobytes()

    def blanks(self, n: int) -> list[int]:
        """A run of blanks: their pieces have one score, so merging goes from
        the left, again and again."""
        if n not in self.runs:
            parts = [1] * min(n, 64)
            at = 0
            while at < len(parts) - 1:
                if SPACE_PIECE * (parts[at] + parts[at + 1]) in self.id_of:
                    parts[at:at + 2] = [parts[at] + parts[at + 1]]
                    at = max(at - 1, 0)
                else:
                    at += 1
            ids = [self.id_of[SPACE_PIECE * p] for p in parts]
            self.runs[n] = ids if n <= 64 else self._long_run(n)
        return self.runs[n]

    def _long_run(self, n: int) -> list[int]:
        widest = max(len(t) for t in self.id_of if not t.strip(SPACE_PIECE))
        whole, rest = divmod(n - widest, widest)
        return [self.id_of[SPACE_PIECE * widest]] * whole + self.blanks(widest + rest)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the library's encode() without extras."""
        split = [self._words(t) for t in texts]
        # A run of blanks is no word; see _settled().
        every = [w for w in set().union(*split) if w[1:2] != SPACE_PIECE]
        fresh = [w for w in every if w not in self.words]
        if len(self.words) + len(fresh) > CACHE_WORDS:  # a cache: cleared, never outgrown
            self.words.clear()
            fresh = every
        todo = fresh
        self.words.update(zip(todo, self.segment(todo), strict=True))
        known = self.words.__getitem__
        found = [np.frombuffer(b"".join(map(known, self._settled(words))), "<i4") for words in split]
        for w in todo:
            if len(w) > CACHED_WORD:
                del self.words[w]
                self.words.pop(f"{SPACE_PIECE}{SPACE_PIECE}{w}", None)
        return found

    def _words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = SPACE_PIECE + text.replace(" ", SPACE_PIECE)
        words = WORD.findall(marked)
        if not LONG.search(marked):
            return words
        return [part for w in words for part in ([w] if len(w) <= LONG_WORD else self.parts(w))]

    def _settled(self, words: list[str]) -> list[str]:
        """Words, with runs of blanks (words of one character, up to the next
        word's own blank) replaced by keys of their pieces."""
        if SPACE_PIECE not in words:
            return words
        out, run = [], 0
        for w in words:
            if w == SPACE_PIECE:
                run += 1
                continue
            if run:
                # The last blank joins the run if its word leaves it alone.
                ids = self.words[w]
                alone = ids[:4] == self.lone
                self._key(out, run + alone)
                if alone:
                    bare = f"{SPACE_PIECE}{SPACE_PIECE}{w}"
                    self.words[bare] = ids[4:]
                    w = bare
                run = 0
            out.append(w)
        if run:
            self._key(out, run)
        return out

    def _key(self, out: list[str], n: int) -> None:
        key = SPACE_PIECE * (n + 1)
        if key not in self.words:
            self.words[key] = np.array(self.blanks(n), "<i4").tobytes()
        out.append(key)

    def decode(self, ids: list[int]) -> str:
        """Text of ids: bytes back to characters, blanks for their sign, and
        without the blank that encoding puts first."""
        text = b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, piece_ids) per row; null and empty texts have no pieces.

    The ids equal the library's. A text that holds the blank's sign itself
    decodes to blanks there. Repeated rows repeat; an empty table gives no rows.
    """

    def run(batches):
        model = PieceModel.at(model_path)
        for batch in record_batches(batches, "text", BATCH_BYTES):
            bounds, ids = _flat(model.encode([t or "" for t in batch.column("text").to_pylist()]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, ids)], ["doc_id", "piece_ids"])

    workers_import(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece_ids array<int>")


def code_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, piece_ids, decoded) per row: the ids, and the text that they
    decode to (the whole text again, null as empty)."""

    def run(batches):
        model = PieceModel.at(model_path)
        for batch in record_batches(batches, "text", BATCH_BYTES):
            found = model.encode([t or "" for t in batch.column("text").to_pylist()])
            bounds, ids = _flat(found)
            texts = pa.array([model.decode(x.tolist()) for x in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(bounds, ids), texts], ["doc_id", "piece_ids", "decoded"])

    workers_import(docs.sparkSession)
    narrow = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, piece_ids array<int>, decoded string")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, piece_ids); null ids give null."""

    def run(batches):
        model = PieceModel.at(model_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # a few hundred id lists at a time as Python numbers
                part = batch.slice(at, 256)
                texts = [None if ids is None else model.decode(ids) for ids in part.column("piece_ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    workers_import(encoded.sparkSession)
    return encoded.select("doc_id", "piece_ids").mapInArrow(run, "doc_id long, text string")


def with_pieces(docs: DataFrame, model_path: str) -> DataFrame:
    """``docs`` with n_pieces and piece_ids, row by row: texts don't move. A
    column of these names is replaced."""
    names = [f for f in docs.schema.fields if f.name not in ("n_pieces", "piece_ids")]

    def run(batches):
        model = PieceModel.at(model_path)
        for batch in record_batches(batches, "text", BATCH_BYTES):
            bounds, ids = _flat(model.encode([t or "" for t in batch.column("text").to_pylist()]))
            columns = [batch.column(f.name) for f in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(bounds), pa.int64()), pa.ListArray.from_arrays(bounds, ids)],
                                             [*[f.name for f in names], "n_pieces", "piece_ids"])

    workers_import(docs.sparkSession)
    schema = T.StructType([*names, T.StructField("n_pieces", T.LongType()), T.StructField("piece_ids", T.ArrayType(T.IntegerType()))])
    return docs.select(*[f.name for f in names]).mapInArrow(run, schema)


def _flat(found: list[np.ndarray]) -> tuple[pa.Array, pa.Array]:
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
    return pa.array(bounds), pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32())

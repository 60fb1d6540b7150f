"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Adjacent symbol pairs wait in an agenda ordered by the score of the piece they would make, then by
position; the best pair is merged, its two new neighbour pairs enter the agenda, until none is left.
The agenda is kept for many chunks at once as numpy rows, so a merge of thousands of chunks is a few
array operations.

A text is cut into chunks at places no vocabulary piece spans: a blank always starts a piece, and a
line feed is part of none (both are read off the vocabulary; for models where this does not hold the text,
as the library normalizes it, is one chunk). Merges of one chunk never touch another, so chunks are encoded
once and short ones kept in a bounded cache. Long chunks have a heap of their own each.

The ids are the agenda's. All newly encoded chunks are checked against the sentencepiece library in the same
Arrow batch: a chunk where the two differ takes the library's ids, and ``n_corrected`` counts a row's such
chunks; where more than a hundredth of a batch's new chunks differ the agenda does not fit the model, and the
job fails.

Null and empty texts encode to the end id alone. White space runs, control characters and characters
outside the vocabulary (byte pieces) follow the library; the mark itself (U+2581) in a text is a blank, as
there. Repeated rows encode alike; extra columns stay, but those named like a new one are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import append

NONE = np.iinfo(np.int32).max
MARK = "▁"
#: Chunks kept per Python worker, about 220 bytes each.
CACHE = 500_000
#: Widths to which chunks are filled up, so that few shapes occur; longer ones go in groups of their length.
WIDTHS = (4, 6, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64)
FILL = "\uffff"
#: Characters of the longest chunk that is kept beyond its batch.
LONGEST = 256


class Codec:
    """Encodes and decodes with one SentencePiece model file of BPE type.

    A chunk is named by its text: ``"\\n" + word`` for a line feed and what follows it directly, else
    the text after its first blank (which may start with further blanks, or be empty).
    """

    def __init__(self, model_file: str, cache: int = CACHE):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.unknown = n
        self.end = sp.eos_id()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        ids = {sp.id_to_piece(i): i for i in normal}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.first = np.full(0x110000, self.unknown, np.int32)  # symbol of a code point
        for b in range(128):
            self.first[b] = self.bytes[b]
        for piece, i in ids.items():
            if len(piece) == 1:
                self.first[ord(piece)] = i
        #: Whether chunks never touch each other, and nothing but pairs and scores decides.
        plain = not any(MARK in p.lstrip(MARK) or "\n" in p for p in ids) and MARK in ids
        if any(sp.is_unused(i) for i in range(n)) or sp.unk_id() in self.bytes:
            raise ValueError("only merge-type vocabularies with byte pieces, of which all pieces are used")
        self.plain = plain and self._unchanged()
        self.first[ord(" ")] = ids.get(MARK, self.unknown)
        self.first[ord(FILL)] = self.unknown
        rank = {s: k for k, s in enumerate(sorted({sp.get_score(i) for i in normal}, reverse=True))}
        keys, ranks, made = [], [], []
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    keys.append(left * (n + 1) + right)
                    ranks.append(rank[sp.get_score(i)])
                    made.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, np.int32)[order], NONE)
        self.made = np.append(np.array(made, np.int32)[order], 0)
        self.text = [str(i) for i in range(n)]
        self.most = cache
        self.known: dict[str, bytes] = {}
        self.wrong: set[str] = set()
        self._pairs: dict[int, tuple[int, int]] | None = None

    def _unchanged(self) -> bool:
        """Whether the model takes characters as they are, each blank as a mark, after one mark of its own."""
        sp, probe = self.library, "  a  \ufb01 e\u0301\t A\u030a\u3000\n b "
        return sp.decode(sp.encode(probe)) == probe and sp.encode("\n") == [*sp.encode("\n ")[:2]] and sp.encode("  \n")[:1] != sp.encode("\n")[:1]

    # ---- the agenda

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and id of the piece that each pair makes; NONE where there is no such piece."""
        key = a.astype(np.int64) * (self.unknown + 1) + b
        at = np.searchsorted(self.keys, key)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def agenda(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk by the merges of its pairs, best score first."""
        full = [c if c[:1] == "\n" else " " + c for c in chunks] if self.plain else chunks
        by_width: dict[int, list[int]] = {}
        out: list = [None] * len(chunks)
        wide = [next(w for w in WIDTHS if w >= n) for n in range(WIDTHS[-1] + 1)]
        for k, c in enumerate(full):
            if len(c) > WIDTHS[-1]:
                out[k] = self._merge_long(c)
            else:
                by_width.setdefault(wide[len(c)], []).append(k)
        for width, which in by_width.items():
            step = max(1, 400_000 // width)
            for s in range(0, len(which), step):
                part = which[s : s + step]
                for k, ids in zip(part, self._merge([full[k] for k in part], width), strict=True):
                    out[k] = ids
        return out

    def _merge_long(self, chunk: str) -> list[int]:
        """The same agenda as a heap: each merge costs the logarithm of the chunk's length."""
        if self._pairs is None:
            self._pairs = dict(zip(self.keys[:-1].tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        find, base, n, none = self._pairs.get, self.unknown + 1, len(chunk), (NONE, 0)
        start = self.first[np.frombuffer(chunk.encode("utf-32-le"), np.uint32)]
        ranks, made = (x.tolist() for x in self._look(start[:-1], start[1:]))  # of the pair that begins at a place
        ranks.append(NONE)
        made.append(0)
        heap = [r << 32 | i for i, r in enumerate(ranks) if r != NONE]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        sym, right, left = start.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            e = pop(heap)
            i = e & 0xFFFFFFFF
            if ranks[i] != e >> 32:
                continue  # one of the two symbols has changed since
            j = right[i]
            sym[i] = s = made[i]
            sym[j], ranks[j] = -1, NONE
            right[i] = after = right[j]
            if after < n:
                left[after] = i
                ranks[i], made[i] = r, _ = find(s * base + sym[after], none)
                if r != NONE:
                    push(heap, r << 32 | i)
            else:
                ranks[i] = NONE
            if (b := left[i]) >= 0:
                ranks[b], made[b] = r, _ = find(sym[b] * base + s, none)
                if r != NONE:
                    push(heap, r << 32 | b)
        unknown = self.unknown
        return list(chain.from_iterable([s] if s != unknown else [self.bytes[b] for b in c.encode()] for s, c in zip(sym, chunk, strict=True) if s >= 0))

    def _merge(self, chunks: list[str], n: int) -> list[list[int]]:
        unknown, m = self.unknown, len(chunks)
        codes = np.frombuffer("".join([c.ljust(n, FILL) for c in chunks]).encode("utf-32-le"), np.uint32)
        sym = self.first[codes].reshape(m, n)
        alive = np.arange(n) < np.fromiter(map(len, chunks), np.int32, m)[:, None]
        if n > 1:
            rank, made = (x.reshape(m, n - 1) for x in self._look(sym[:, :-1].ravel(), sym[:, 1:].ravel()))
            right = np.tile(np.arange(1, n + 1, dtype=np.int32), (m, 1))
            left = np.tile(np.arange(-1, n - 1, dtype=np.int32), (m, 1))
            rows = np.arange(m)
            while True:
                held = rank if rows.size == m else rank[rows]
                at = held.argmin(axis=1)
                go = held[np.arange(rows.size), at] != NONE
                rows, at = rows[go], at[go]
                if not rows.size:
                    break
                gone = right[rows, at]
                new = made[rows, at]
                sym[rows, at] = new
                alive[rows, gone] = False
                after, before = right[rows, gone], left[rows, at]
                right[rows, at] = after
                inner = gone < n - 1
                rank[rows[inner], gone[inner]] = NONE
                has, had = after < n, before >= 0
                r, a, b = rows[has], at[has], after[has]
                q, f = rows[had], before[had]
                left[r, b] = a
                got = self._look(np.concatenate([new[has], sym[q, f]]), np.concatenate([sym[r, b], new[had]]))
                rank[rows[~has], at[~has]] = NONE
                rank[r, a], made[r, a] = got[0][: r.size], got[1][: r.size]
                rank[q, f], made[q, f] = got[0][r.size :], got[1][r.size :]
        odd = ((sym == unknown) & alive).any(axis=1)
        flat, counts = sym[alive].tolist(), alive.sum(axis=1).tolist()
        out, p = [], 0
        for c in counts:
            out.append(flat[p : p + c])
            p += c
        for k in np.flatnonzero(odd).tolist():
            where = np.flatnonzero(alive[k]).tolist()
            out[k] = list(chain.from_iterable([i] if i != unknown else [self.bytes[b] for b in chunks[k][j].encode()] for i, j in zip(out[k], where, strict=True)))
        return out

    # ---- chunks

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text, in order."""
        if not text:
            return []
        out: list[str] = []
        for number, line in enumerate(text.split("\n")):
            parts = line.split(" ")
            if number:
                parts[0] = "\n" + parts[0]
            if "" in parts:
                out += self._blanks(parts)
            else:
                out += parts
        return out

    @staticmethod
    def _blanks(parts: list[str]) -> list[str]:
        """Blanks in a row belong to one chunk, with the word after them."""
        out, held = [], ""
        for p in parts[:-1]:
            if p:
                out.append(held + p)
                held = ""
            else:
                held += " "
        out.append(held + parts[-1])
        return out

    def learn(self, chunks: set[str]) -> None:
        """Encodes chunks not yet kept by the agenda, and checks them against the library."""
        known = self.known
        new = [c for c in chunks if c not in known]
        if not new:
            return
        if len(known) + len(new) > self.most:
            held = {c: known[c] for c in chunks if c in known}
            known.clear()
            known.update(held)
            self.wrong &= held.keys()
        got, true = self.agenda(new), self._checked(new)
        if got != true:
            bad = [k for k, (a, b) in enumerate(zip(got, true, strict=True)) if a != b]
            if len(bad) > max(1, len(new) // 100):
                raise RuntimeError(f"the agenda differs from the library in {len(bad)} of {len(new)} chunks: {new[bad[0]][:40]!r}")
            for k in bad:
                got[k] = true[k]
                self.wrong.add(new[k])
        flat = np.fromiter(chain.from_iterable(got), np.int32)
        ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) * 4).tolist()
        data = flat.tobytes()
        known.update(zip(new, (data[a:b] for a, b in zip([0, *ends], ends)), strict=True))

    def _checked(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of chunks."""
        true = self.library.encode(chunks, num_threads=1)
        for k, c in enumerate(chunks):
            if c[:1] == "\n":
                true[k] = true[k][1:]
            elif not c:
                true[k] = self.library.encode("\n ")[2:]
        return true

    # ---- texts

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[int]]:
        """Ids with the end id of each text, and how many of its chunks the library corrected."""
        texts = [(t or "").replace(MARK, " ") for t in texts]
        if not self.plain:
            return self._encode_whole(texts)
        cut = [self.chunks(t) for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        end = np.int32(self.end).tobytes()
        get, wrong = self.known.__getitem__, self.wrong
        ids = [np.frombuffer(b"".join(map(get, c)) + end, np.int32).tolist() for c in cut]
        counts = [sum(x in wrong for x in c) for c in cut] if wrong else [0] * len(cut)
        for c in [c for c in self.known if len(c) > LONGEST] if any(len(t) > LONGEST for t in texts) else ():
            del self.known[c]
            wrong.discard(c)
        return ids, counts

    def _encode_whole(self, texts: list[str]) -> tuple[list[list[int]], list[int]]:
        """Each text, as the library normalizes it, is one chunk."""
        normal = [self.library.normalize(t) for t in texts]
        got, true = self.agenda(normal), self.library.encode(texts, num_threads=1)
        bad = [int(a != b) for a, b in zip(got, true, strict=True)]
        if sum(bad) > max(1, len(bad) // 100):
            raise RuntimeError(f"the agenda differs from the library in {sum(bad)} of {len(bad)} texts")
        return [[*(b if wrong else a), self.end] for a, b, wrong in zip(got, true, bad, strict=True)], bad

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


@lru_cache(maxsize=2)
def codec(model_file: str) -> Codec:
    """One per Python worker, so its cache outlives a task."""
    return Codec(model_file)


FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_sha256", T.StringType()),
    T.StructField("decoded_sha256", T.StringType()),
    T.StructField("n_corrected", T.LongType()),
]


def encode(df: DataFrame, model_file: str, text: str = "text", ids: bool = False, decoded: bool = False) -> DataFrame:
    """Appends ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and ``n_corrected``.

    ``ids`` and ``decoded`` append the token ids and the decoded text themselves, as ``piece_ids`` and
    ``decoded_text``. Null texts count as empty; an empty table gives an empty result.
    """
    fields = FIELDS + [T.StructField("piece_ids", T.ArrayType(T.IntegerType(), False))] * ids + [T.StructField("decoded_text", T.StringType())] * decoded

    def make():
        c = codec(model_file)

        def run(texts):
            got, bad = c.encode(texts)
            back = c.decode(got)
            name = c.text.__getitem__
            sha = lambda xs: [hashlib.sha256(x.encode()).hexdigest() for x in xs]
            out = [[len(i) for i in got], sha(" ".join(map(name, i)) for i in got), sha(back), bad]
            return out + [got] * ids + [back] * decoded

        return run

    return append(df, text, fields, make, rows=1024)


def decode(df: DataFrame, model_file: str, ids: str = "piece_ids") -> DataFrame:
    """Appends ``decoded_text``, the library's decoding of a column of id lists; null gives the empty text."""
    import pyarrow as pa

    schema = T.StructType([df.schema[c] for c in df.columns if c != "decoded_text"] + [T.StructField("decoded_text", T.StringType())])
    keep = [c for c in df.columns if c != "decoded_text"]

    def run(batches):
        c = codec(model_file)
        for b in batches:
            back = c.decode([x or [] for x in b.column(ids).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(back, pa.string())], names=[*keep, "decoded_text"])

    return df.mapInArrow(run, schema)

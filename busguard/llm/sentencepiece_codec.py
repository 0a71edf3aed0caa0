"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

The text is cut into chunks where no piece of the vocabulary can reach across (before a run of word
marks that follows another character; the vocabulary is checked for that, else the whole text is one
chunk).  Each chunk is encoded by an agenda of adjacent symbol pairs ordered by score, leftmost first
among equals: the best pair is merged, its two neighbours enter the agenda anew, until no adjacent pair
is a piece.  Symbols outside the vocabulary fall back to byte pieces, or to the unknown id.

Every chunk a worker meets for the first time is compared with the sentencepiece library, one call per
Arrow batch; a difference fails the job.  Known chunks are kept in a dictionary that is emptied when it
reaches ``MEMO_CHUNKS`` entries, so a worker's memory is bounded.

Defined results: null text counts as empty; the empty text has only the begin and end ids and decodes
to ''.  Rows are independent: repeated rows give repeated results, an empty table gives none, other
columns pass through.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busguard.llm.common import col, free_name, give_back, text_or_empty

MARK = "▁"
MEMO_CHUNKS = 200_000
MEMO_CHARS = 256  # longer chunks are encoded each time
SHORT = 48  # chunks up to this length are encoded many at a time, longer ones one by one with a heap
CHARS_AT_ONCE = 1_000_000  # of the texts that are cut into chunks together
ROWS = 512  # texts of a batch whose ids and decoded texts are held together
NO_PAIR = 1 << 40
MODEL = "piece_bpe_32k.model"

ENCODED = "ids binary, n_tokens long, decoded string"


def model_path(name_or_path: str) -> str:
    """Path of a model: as given when it has a folder part, else a file of the public tokenizers."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers
    return public_tokenizers.path(name_or_path)


class Codec:
    """Encoder and decoder of one model; see the module text."""

    def __init__(self, path: str, verify: bool = True):
        import sentencepiece
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.verify = verify
        n = self.sp.get_piece_size()
        special = (self.sp.is_control, self.sp.is_unknown, self.sp.is_byte, self.sp.is_unused)
        normal = [i for i in range(n) if not any(kind(i) for kind in special)]
        self.ids = {self.sp.id_to_piece(i): i for i in normal}
        self.scores = {self.sp.id_to_piece(i): self.sp.get_score(i) for i in normal}
        self.bytes = {int(self.sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if self.sp.is_byte(i)}
        crosses = any(MARK in p.lstrip(MARK) for p in self.ids)
        cut = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))  # in no piece: stand alone
        self.chunks = re.compile("(?s).+" if crosses else f"{MARK}+[^{MARK}{cut}]*|[^{MARK}{cut}]+|[{cut or MARK}]")
        self.lead = cut[:1]
        self.lead_ids = len(self.sp.encode(self.lead)) if cut else 0
        self.begin = self.sp.bos_id().to_bytes(4, "little")
        self.end = self.sp.eos_id().to_bytes(4, "little")
        self.memo: dict[str, bytes] = {}
        self._pair_tables()

    def _pair_tables(self) -> None:
        """Which two pieces join into a third, and how early: sorted keys for lookups of whole arrays."""
        order = {score: rank for rank, score in enumerate(sorted(set(self.scores.values()), reverse=True))}
        rows = []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                left, right = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left << 32 | right, order[self.scores[piece]], i))
        rows.sort()
        table = np.array(rows or [(-1, 0, 0)], dtype=np.int64)
        self.pair_keys, self.pair_ranks, self.pair_ids = table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
        self.char_ids = np.full(0x110000, -1, dtype=np.int64)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.char_ids[ord(piece)] = i
        # a character that is no piece itself may still be part of one: such chunks take the heap
        lone = {c for piece in self.ids for c in piece} - self.ids.keys()
        for c in lone:
            self.char_ids[ord(c)] = -1

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        found = (self.pair_keys[at] == keys) & (right >= 0)
        return np.where(found, self.pair_ranks[at], NO_PAIR), self.pair_ids[at]

    def _encode_equal(self, chunks: list[str]) -> list[bytes]:
        """Chunks of one length, all at once: row i holds the symbols of chunk i and the agenda of its pairs."""
        n, width = len(chunks), len(chunks[0])
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols = self.char_ids[points].reshape(n, width)
        plain = (symbols >= 0).all(axis=1)
        out: list[bytes] = [b""] * n
        for i in np.flatnonzero(~plain):
            out[i] = self._encode_by_heap(chunks[i])
        rows = np.flatnonzero(plain)
        symbols = symbols[plain]
        sizes = np.full(len(rows), width)
        final = symbols.copy()
        if width > 1 and len(rows):
            ranks, merged = self._ranks(symbols[:, :-1], symbols[:, 1:])
            live = np.arange(len(rows))
            while len(live):
                best = ranks.argmin(axis=1)  # the leftmost of the best
                each = np.arange(len(live))
                going = ranks[each, best] < NO_PAIR
                final[live[~going], :symbols.shape[1]] = symbols[~going]
                live, best, symbols, ranks, merged = live[going], best[going], symbols[going], ranks[going], merged[going]
                if not len(live):
                    break
                each = each[:len(live)]
                sizes[live] -= 1
                symbols[each, best] = merged[each, best]
                w = symbols.shape[1]
                move = np.arange(w - 1)[None, :] > best[:, None]  # what stands right of the pair moves one left
                symbols = np.where(move, symbols[:, 1:], symbols[:, :-1])
                if w == 2:
                    final[live, :1] = symbols
                    break
                gap = np.arange(w - 2)[None, :] >= best[:, None]
                ranks, merged = np.where(gap, ranks[:, 1:], ranks[:, :-1]), np.where(gap, merged[:, 1:], merged[:, :-1])
                for at, ok in ((best - 1, best > 0), (best, best < w - 2)):
                    r, c = each[ok], at[ok]
                    ranks[r, c], merged[r, c] = self._ranks(symbols[r, c], symbols[r, c + 1])
        packed = final.astype("<u4")
        for i, row, size in zip(rows.tolist(), packed, sizes.tolist()):
            out[i] = row[:size].tobytes()
        return out

    def _by_heap(self, chunk: str) -> list[str]:
        """Pieces of one chunk of any length."""
        parts = list(chunk)
        before = list(range(-1, len(parts) - 1))
        after = list(range(1, len(parts) + 1))
        agenda: list[tuple[float, int, str]] = []
        for i, pair in enumerate(map(str.__add__, parts, parts[1:])):
            if pair in self.scores:
                agenda.append((-self.scores[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, left, joined = heapq.heappop(agenda)
            right = after[left]
            if not parts[left] or right >= len(parts) or parts[left] + parts[right] != joined:
                continue  # one side has been merged meanwhile
            parts[left], parts[right] = joined, ""
            after[left] = after[right]
            if after[left] < len(parts):
                before[after[left]] = left
            for a, b in ((before[left], left), (left, after[left])):
                if a >= 0 and b < len(parts) and (pair := parts[a] + parts[b]) in self.scores:
                    heapq.heappush(agenda, (-self.scores[pair], a, pair))
        return [p for p in parts if p]

    def _encode_by_heap(self, chunk: str) -> bytes:
        out = []
        for piece in self._by_heap(chunk):
            if (i := self.ids.get(piece)) is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.sp.unk_id())
        return np.array(out, dtype="<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        by_length: dict[int, list[str]] = {}
        for c in new:
            by_length.setdefault(len(c), []).append(c)
        memo = self.memo
        for length, chunks in by_length.items():
            if length <= SHORT:
                memo.update(zip(chunks, self._encode_equal(chunks)))
            else:
                memo.update((c, self._encode_by_heap(c)) for c in chunks)
        if self.verify:
            self._compare(new)

    def _compare(self, new: list[str]) -> None:
        """Every new chunk as the library encodes it.  It puts a word mark before a text, so a chunk without
        one is encoded behind a character that joins with nothing."""
        marked = [c for c in new if c[0] == MARK and c != MARK]
        bare = [c for c in new if c[0] != MARK] if self.lead else []
        expected = self.sp.encode([c[1:].replace(MARK, " ") for c in marked] + [self.lead + c for c in bare],
                                  num_threads=1)
        for i in range(len(marked), len(expected)):
            expected[i] = expected[i][self.lead_ids:]
        ours = b"".join(map(self.memo.__getitem__, marked + bare))
        if np.fromiter(itertools.chain.from_iterable(expected), dtype="<u4").tobytes() != ours:
            wrong = next(c for c, ids in zip(marked + bare, expected)
                         if np.array(ids, "<u4").tobytes() != self.memo[c])
            raise ValueError(f"the agenda and the library differ on {wrong[:200]!r}")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, begin and end ids included, as little-endian unsigned 32-bit integers."""
        out = []
        ends = np.cumsum([len(t) for t in texts]) // CHARS_AT_ONCE
        for _, group in itertools.groupby(zip(ends.tolist(), texts), key=lambda x: x[0]):
            part = [self.chunks.findall(MARK + t.replace(" ", MARK)) if t else [] for _, t in group]
            new = list(set().union(*part).difference(self.memo))
            self._learn(new)
            get = self.memo.__getitem__
            out.extend(b"".join((self.begin, *map(get, chunks), self.end)) for chunks in part)
            for c in new:
                if len(c) > MEMO_CHARS:
                    del self.memo[c]
            if len(self.memo) > MEMO_CHUNKS:
                self.memo = {}
        return out

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(memoryview(ids).cast("I").tolist())


def encode_decode(docs: DataFrame, text: str = "text", model: str = MODEL, ids_as: str = "ids",
                  count_as: str = "n_tokens", decoded_as: str = "decoded") -> DataFrame:
    """``docs`` with its texts' ids (binary, 4 bytes little-endian each), their count and the decoded text.

    Columns of these names are replaced; all others stay.
    """

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = Codec(model_path(model))
        for texts in batches:
            for begin in range(0, len(texts), ROWS):  # ids and decoded texts of a whole batch would be much memory
                ids = codec.encode(texts.iloc[begin:begin + ROWS].tolist())
                yield pd.DataFrame({"ids": ids, "n_tokens": [len(b) // 4 for b in ids],
                                    "decoded": [codec.decode(b) for b in ids]})
        del codec
        give_back()

    out = free_name(docs, "coded")
    coded = docs.withColumn(out, run(text_or_empty(col(docs, text))))
    return coded.withColumns({ids_as: F.col(out)["ids"], count_as: F.col(out)["n_tokens"],
                              decoded_as: F.col(out)["decoded"]}).drop(out)

"""Best-fit packing with swap-based local search.

Texts become token ids by a public tokenizer, documents end with a separator id, and only documents longer than a sequence
are cut. Pieces are dealt to blocks of about ``BLOCK`` pieces by a hash of their place in the written table, so that every block is a fair sample of lengths and
no key can be hot; a block is packed best fit first (longest pieces first). Then every underfull bin, fullest first, takes the piece,
the exchange one for one or two for one that raises its fill most, from all underfull bins of the block (pieces are indexed by
length), whenever that raises the sum of squared fills; this goes on until a whole round finds none. Empty bins go.

Defined results: null and empty texts are one piece of the separator alone; only ``doc_id`` and ``text`` are read, other columns do not
matter; repeated rows are packed as often as they
occur; an empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from specmill.llm import shared

CAPACITY, SEPARATOR, BLOCK = 2048, 0, 16384
VOCABULARY = "word_bpe_49k.json"
#: Chunks whose ids a worker remembers at once (some 40 bytes each); more only cost time, never results.
REMEMBERED = 1_200_000


class Encoder:
    """Ids of whole texts. The tokenizer never joins across a blank or line end, so it encodes each distinct chunk once.

    It lowers letters and cuts off marks after a letter or digit anyway, so a leading capital is lowered and trailing marks are
    a chunk of their own. Known chunks are named by 128 bits, sorted, in flat arrays: some 40 bytes each.
    """

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.clear()

    def clear(self) -> None:
        self.name, self.proof, self.first, self.size = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _learned(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, and how many each has. They are encoded joined by blanks; a token's place tells its chunk."""
        ids, sizes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int32)]
        for s in range(0, len(chunks), 4000):
            part = chunks[s:s + 4000]
            e = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            size = np.fromiter(map(len, part), np.int64, len(part)) + 1
            begins = np.cumsum(size) - size
            place = np.fromiter((o[0] for o in e.offsets), np.int64, len(e.ids))
            ids.append(np.array(e.ids, np.uint32))
            sizes.append(np.bincount(np.searchsorted(begins, place, side="right") - 1, minlength=len(part)).astype(np.int32))
        return np.concatenate(ids), np.concatenate(sizes)

    def _find(self, name: np.ndarray, proof: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.name, name)
        near = np.minimum(at, max(len(self.name) - 1, 0))
        known = (self.name[near] == name) & (self.proof[near] == proof) if len(self.name) else np.zeros(len(name), bool)
        return np.where(known, near, -1)

    def _learn(self, name: np.ndarray, proof: np.ndarray, chunks: list[str]) -> None:
        ids, sizes = self._learned(chunks)
        first = len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes
        self.flat = np.concatenate([self.flat, ids])
        order = np.argsort(np.concatenate([self.name, name]), kind="stable")
        self.name, self.proof, self.first, self.size = (np.concatenate(x)[order] for x in ((self.name, name), (self.proof, proof), (self.first, first), (self.size, sizes)))

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and n+1 places. ``raw`` holds the texts' bytes, ``offsets`` their n+1 places."""
        if len(self.name) > REMEMBERED:
            self.clear()
        begin, end, doc = _chunks(raw, offsets)
        if not len(begin):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        low = raw.copy()
        capital = begin[(low[begin] >= 65) & (low[begin] <= 90)]
        low[capital] += 32
        name = shared.Spans(low).of(begin, end)
        proof = shared.Spans(_OTHER[low]).of(begin, end)
        _, place, which = np.unique(name, return_index=True, return_inverse=True)
        if (proof != proof[place][which]).any():  # one hash of two chunks: the pair tells them apart
            _, place, which = np.unique(np.stack([name, proof], 1), axis=0, return_index=True, return_inverse=True)
        one, two = name[place], proof[place]
        at = self._find(one, two)
        new = np.flatnonzero(at < 0)
        if len(new):
            buffer = low.tobytes()
            self._learn(one[new], two[new], [buffer[s:e].decode() for s, e in zip(begin[place[new]].tolist(), end[place[new]].tolist(), strict=True)])
            at = self._find(one, two)
        if (at < 0).any():  # a name that was taken by another chunk: found by its proof
            for i in np.flatnonzero(at < 0).tolist():
                same = np.flatnonzero((self.name == one[i]) & (self.proof == two[i]))
                at[i] = same[0]
        first, size = self.first[at][which], self.size[at][which].astype(np.int64)
        ends = np.cumsum(size)
        ids = self.flat[np.arange(ends[-1]) + np.repeat(first - (ends - size), size)]
        per = np.bincount(doc, weights=size, minlength=len(offsets) - 1).astype(np.int64)
        return ids, np.concatenate([[0], np.cumsum(per)])


#: Another naming of bytes, for the second hash of a chunk.
_OTHER = np.random.default_rng(7).permutation(256).astype(np.uint8)
_MARK = np.zeros(256, bool)
_MARK[list(b".,;:!?")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def _chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end and text of the runs of bytes without blank and line end, marks at their end apart; none reaches over the
    border of two texts."""
    inside = np.concatenate([[False], (raw != 32) & (raw != 10), [False]])
    change = inside[1:] != inside[:-1]
    change[offsets] = True
    begin = np.flatnonzero(change[:-1] & inside[1:-1])
    end = np.flatnonzero(change[1:] & inside[1:-1]) + 1
    last = np.maximum.accumulate(np.where(_MARK[raw], -1, np.arange(len(raw)))) if len(raw) else begin
    core = last[end - 1] + 1 if len(end) else end
    cut = np.flatnonzero((core > begin) & (core < end))
    cut = cut[_ALNUM[raw[core[cut] - 1]]]
    begin, end = np.concatenate([begin, core[cut]]), np.concatenate([np.where(np.isin(np.arange(len(end)), cut), core, end), end[cut]])
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], end[order]
    return begin, end, np.searchsorted(offsets, begin, side="right") - 1


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, and the ids themselves on demand."""
    schema = f"{doc_id} {docs.schema[doc_id].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        if vocabulary not in _ENCODERS:
            _ENCODERS[vocabulary] = Encoder(public_tokenizers.path(vocabulary))
        encoder = _ENCODERS[vocabulary]
        end = np.array([separator], "<u4")
        for batch in shared.by_bytes(batches, 1, 4 << 20):
            ids, places = encoder.encode(*shared.text_bytes(batch.column(1)))
            owner, columns, parts = [], ([], [], [], []), []
            for i in range(batch.num_rows):
                own = np.concatenate([ids[places[i]:places[i + 1]], end]).astype("<u4", copy=False)
                for k, s in enumerate(range(0, len(own), capacity)):
                    part = own[s:s + capacity]
                    owner.append(i)
                    for column, x in zip(columns, (k, s, len(part), zlib.crc32(part.tobytes())), strict=True):
                        column.append(x)
                    if with_ids:
                        parts.append(part.astype(np.int32))
            made = [batch.column(0).take(pa.array(owner, pa.int64())), *[pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]]
            names = [doc_id, "piece", "start", "length", "ids_crc32"]
            if with_ids:
                made, names = [*made, pa.array(parts, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(made, names=names)

    return docs.select(F.col(doc_id), F.col(text)).mapInArrow(cut, schema)


class Bins:
    """Bins of one block: best-fit placement, then local search among the underfull ones."""

    def __init__(self, lengths: np.ndarray, capacity: int):
        self.size, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.fill: list[int] = []

    def best_fit(self) -> None:
        free: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        open_ = 0  # bit f: a bin with f free places exists
        for i in np.argsort(-self.size, kind="stable").tolist():
            n = int(self.size[i])
            if fitting := open_ >> n:
                f = n + (fitting & -fitting).bit_length() - 1
                b = free[f].pop()
                if not free[f]:
                    open_ &= ~(1 << f)
                self.bins[b].append(i)
            else:
                f, b = self.capacity, len(self.bins)
                self.bins.append([i])
                self.fill.append(0)
            self.fill[b] += n
            free[f - n].append(b)
            open_ |= 1 << (f - n)
        self.where = {i: b for b, own in enumerate(self.bins) for i in own}

    def search(self) -> None:
        """Rounds of exchanges among all underfull bins, until a round finds none. Each raises the sum of squared fills, so this ends."""
        while self._round():
            pass

    def _round(self) -> bool:
        """Every underfull bin, fullest first, takes what fills it best; the emptiest bins that have it give it.

        Pieces of underfull bins are indexed by length, the emptiest bin's last; entries of pieces that moved are skipped.
        """
        fill, size = self.fill, self.size
        under = sorted((b for b in range(len(self.bins)) if self.bins[b] and fill[b] < self.capacity), key=lambda b: -fill[b])
        self.by_size: dict[int, list[tuple[int, int]]] = {}
        for b in under:
            for i in self.bins[b]:
                self.by_size.setdefault(int(size[i]), []).append((i, b))
        self.moved: set[int] = set()
        self.lengths = np.array(sorted(self.by_size), np.int64)
        self.present = sum(1 << t for t in self.by_size)
        better = False
        for x in under:
            while self.bins[x] and fill[x] < self.capacity and self._improve(x):
                better = True
        return better

    def _piece(self, t: int, x: int, gain: int, but: int = -1) -> int | None:
        """A piece of length ``t`` that another bin may give to ``x`` for a gain: the squares grow if gain > fill[y] - fill[x]."""
        own = self.by_size.get(t, [])
        while own and own[-1][0] in self.moved:
            own.pop()
        for i, y in reversed(own):
            if y == x or i == but or i in self.moved:
                continue
            return i if gain > self.fill[y] - self.fill[x] else None  # the emptiest bin: the others are fuller
        return None

    def _improve(self, x: int) -> bool:
        """One move, exchange one for one or two for one that raises the fill of ``x`` most."""
        room, size = self.capacity - self.fill[x], self.size
        best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
        mine = {0: (), **{int(size[j]): (j,) for j in self.bins[x]}}
        for s, out in mine.items():  # move (nothing goes back), or one for one
            fits = self.present & ((1 << (s + room + 1)) - 1)
            while fits and (t := fits.bit_length() - 1) - s > best[0]:
                i = self._piece(t, x, t - s)
                if i is not None:
                    best = (t - s, out, (i,))
                    break
                fits ^= 1 << t
        if best[0] < room:
            for s, out in mine.items():
                if not s or best[0] == room:
                    continue
                first = self.lengths[self.lengths * 2 <= s + room]
                second = self.lengths[np.searchsorted(self.lengths, s + room - first, side="right") - 1] if len(first) else first
                total = first + second
                for k in np.argsort(-total, kind="stable").tolist():
                    gain = int(total[k]) - s
                    if gain <= best[0]:
                        break
                    i = self._piece(int(first[k]), x, gain)
                    j = self._piece(int(second[k]), x, gain, i) if i is not None else None
                    if j is not None and self._two(x, gain, i, j):
                        best = (gain, out, (i, j))
                        break
        gain, out, in_ = best
        if not gain:
            return False
        givers = [self.where[i] for i in in_]
        for i, y in zip(in_, givers, strict=True):
            self.bins[y].remove(i)
            self.fill[y] -= int(size[i])
            self.bins[x].append(i)
            self.where[i] = x
        for j in out:  # what goes back goes to the first giver
            self.bins[x].remove(j)
            self.bins[givers[0]].append(j)
            self.fill[givers[0]] += int(size[j])
            self.where[j] = givers[0]
        self.fill[x] += gain
        self.moved.update(in_, out)
        return True

    def _two(self, x: int, gain: int, i: int, j: int) -> bool:
        """Two pieces come from one bin, or from two: either way the squares must grow and no bin may overflow."""
        y, z, size, fill = self.where[i], self.where[j], self.size, self.fill
        back = int(size[i] + size[j]) - gain
        if y == z:
            return gain > fill[y] - fill[x]
        after = {x: fill[x] + gain, y: fill[y] - int(size[i]) + back, z: fill[z] - int(size[j])}
        return after[y] <= self.capacity and sum(f * f for f in after.values()) > sum(fill[b] ** 2 for b in after)

    def places(self) -> tuple[np.ndarray, np.ndarray]:
        bin_of, offset = np.zeros(len(self.size), np.int64), np.zeros(len(self.size), np.int64)
        for number, b in enumerate(b for b in self.bins if b):
            bin_of[b] = number
            offset[b] = np.cumsum(self.size[b]) - self.size[b]
        return bin_of, offset


def pack(cut: DataFrame, doc_id: str = "doc_id", capacity: int = CAPACITY, block: int = BLOCK) -> DataFrame:
    """Pieces with sequence_id and offset. ``cut`` is read twice (count, packing), so it should be a written table."""
    blocks = max(1, -(-cut.count() // block))
    dealt = cut.withColumn("_block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)))
    kept = cut.columns

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", doc_id, "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins = Bins(rows["length"].to_numpy(np.int64), capacity)
        bins.best_fit()
        bins.search()
        number, offset = bins.places()
        return rows[kept].assign(sequence_id=(rows["_block"].to_numpy(np.int64) << 32) + number, offset=offset)

    return dealt.groupBy("_block").applyInPandas(place, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema) + ", sequence_id long, offset long")


def packed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    folder = shared.shared_folder(docs.sparkSession)
    return pack(shared.written(pieces(docs, doc_id, text, with_ids=with_ids), folder, "pieces"), doc_id)


def query(spark, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))

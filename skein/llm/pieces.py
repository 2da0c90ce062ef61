"""SentencePiece encoding with seeded merge-dropout, and decoding.

Byte-pair merges are taken from an agenda in order of their scores.  Each candidate that comes
up is dropped with the dropout rate, by a keyed hash of the seed, the document's key and the
place in the document, so a seed gives varied but repeatable segmentations.  With rate 0 the
result is the library's own.  Characters that are no piece fall back to bytes.

Pieces hold the space mark only in front, so a text falls apart into chunks - marks and what
follows them - that are segmented one by one.  Which candidates of a chunk are dropped is drawn
anew for every occurrence; only what follows from a chunk and its drops is kept and reused.

A space mark that stands in the text itself is written as bytes and comes back as itself, so
decoding is lossless (the library would turn it into a space).

Defined results: a null text counts as empty and has no tokens; repeated rows are encoded one
by one, alike if their keys are equal; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_batches, tidied

MARK = "▁"
#: Segmentations that are kept from one batch of texts to the next.
CACHE_STATES = 300_000
#: Chunks up to the last of these many characters are segmented in lockstep, and kept.
WIDTHS = (8, 12, 16, 24, 48)
BATCH_CHARS = 1_500_000
_NONE = 2**31 - 1

_CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


_M64 = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15
#: Steps of an agenda for which one draw says whether all pass; further ones take further draws.
RUN = 512


def _mixed(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & _M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & _M64
    return x ^ (x >> 31)


def _mixed_all(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Codec:
    """Encodes and decodes with one model, dropout rate and seed.

    Every chunk has an agenda of candidate merges.  Long chunks are worked off with a heap;
    short ones in lockstep, many chunks at a time, each giving its best candidate per round.
    Both follow the same rule and give the same pieces.
    """

    def __init__(self, path: str, dropout: float = 0.0, seed: int = 0) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.size = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: -model.get_score(i) for i in plain}
        self.byte = {int(self.pieces[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        value = {i: bytes([b]) for b, i in self.byte.items()} | {i: self.pieces[i].replace(MARK, " ").encode() for i in plain}
        self.value = [value.get(i) for i in range(size)]
        self.mark_bytes = np.array([self.byte[b] for b in MARK.encode()], np.int32)
        # The symbol of each character: its piece, or a number beyond all pieces.
        self.symbol = np.arange(size, size + 0x110000, dtype=np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.limit, self.seed = int(dropout * 2**64), _mixed(seed & _M64)
        # passes[k]: below it, a draw of 64 bits lets the first k steps pass.
        passes = [1 << 64]
        while len(passes) <= RUN:
            passes.append(passes[-1] * ((1 << 64) - self.limit) >> 64)
        self.passes = np.array([min(x, _M64) for x in passes], np.uint64)
        self.falling = [-x for x in passes]
        self._forget()
        # Merges as arrays: sorted keys of (left, right), the merged piece and its rank by score.
        pairs = [(self.ids[p[:k]] * size + self.ids[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids]
        pairs.sort()
        ranks = {v: r for r, v in enumerate(sorted(set(self.score.values())))}
        rank = np.full(size, len(ranks), np.int32)
        for p, i in self.ids.items():
            rank[i] = ranks[self.score[p]]
        self.rank = rank
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.slots, self.merged = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        for key, i in pairs:
            at = (key * 0x9E3779B97F4A7C15 & _M64) >> (64 - bits)
            while self.slots[at] >= 0:
                at = (at + 1) % (1 << bits)
            self.slots[at], self.merged[at] = key, i

    def _forget(self) -> None:
        """Start anew with one state, that of a space mark inside a text, which is written as bytes.

        A state is a chunk with its drops.  Kept are its pieces (a range of ``flat``), its number
        of steps, the symbols of its chunk (a range of ``symbols``), the state that it follows
        from and by which drop; ``after`` tells the state that follows by the next drop.
        """
        self.roots: dict[str, int] = {"": 0}
        self.after: dict[int, int] = {}
        self.flat, self.symbols = self.mark_bytes, np.zeros(0, np.int32)
        self.states = np.array([[0], [len(self.flat)], [0], [0], [0], [-1], [-1]], np.int64)

    def drops_of(self, state: int) -> tuple[int, ...]:
        out: list[int] = []
        while self.states[5, state] >= 0:
            out.append(int(self.states[6, state]))
            state = int(self.states[5, state])
        return tuple(reversed(out))

    def ids_of(self, state: int) -> list[int]:
        at, n = self.states[:2, state].tolist()
        return self.flat[at : at + n].tolist()

    def _merge_all(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair's merge; a rank beyond all others where there is none."""
        key = left.astype(np.int64) * self.size + right
        key[(left >= self.size) | (right >= self.size) | (left < 0) | (right < 0)] = -2
        slot = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        found = self.slots[slot]
        open_ = np.flatnonzero((found != key) & (found >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % len(self.slots)
            found[open_] = self.slots[slot[open_]]
            open_ = open_[(found[open_] != key[open_]) & (found[open_] >= 0)]
        piece = self.merged[slot]
        good = found == key
        return np.where(good, self.rank[piece], _NONE).astype(np.int32), piece

    def _lockstep(self, symbols: np.ndarray, drop_rows: np.ndarray, drop_steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at the end of each row's agenda (-1 behind the last), and how many candidates came up for it.

        Row ``drop_rows[k]`` drops its candidate number ``drop_steps[k]``.
        """
        n, width = symbols.shape
        rank, piece = self._merge_all(symbols[:, :-1].ravel(), symbols[:, 1:].ravel())
        rank, piece = rank.reshape(n, width - 1), piece.reshape(n, width - 1)
        ended = np.empty_like(symbols)
        live, columns = np.arange(n), np.arange(width)
        steps, step = np.zeros(n, np.int64), 0
        order = np.argsort(drop_steps, kind="stable")
        drop_rows, drop_steps = drop_rows[order], drop_steps[order]
        dropping = np.zeros(n, bool)
        while len(live):
            j = rank.argmin(axis=1)  # the leftmost of equals
            going = rank[np.arange(len(live)), j] < _NONE
            if not going.all():
                ended[live[~going]] = symbols[~going]
                live, j = live[going], j[going]
                symbols, rank, piece = symbols[going], rank[going], piece[going]
                if not len(live):
                    break
            steps[live] += 1
            rows = np.arange(len(live))
            now = drop_rows[np.searchsorted(drop_steps, step) : np.searchsorted(drop_steps, step, "right")]
            if len(now):
                dropping[now] = True
                dropped = dropping[live]
                dropping[now] = False
                rank[rows[dropped], j[dropped]] = _NONE
                rows = rows[~dropped]
            step += 1
            symbols, rank, piece = self._merged(symbols, rank, piece, rows, j[rows], columns, width)
        return ended, steps

    def _merged(self, symbols: np.ndarray, rank: np.ndarray, piece: np.ndarray, rows: np.ndarray, j: np.ndarray, columns: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The state after merging the candidate at ``j`` in each of ``rows``."""
        whole = len(rows) == len(symbols)
        s, r, p = (symbols, rank, piece) if whole else (symbols[rows], rank[rows], piece[rows])
        own = np.arange(len(rows))
        s[own, j] = p[own, j]
        # Close the gap behind the merged piece.
        take = np.minimum(columns[None, :] + (columns[None, :] > j[:, None]), width - 1)
        last = take[:, -1:] == width - 1
        s = np.take_along_axis(s, take, 1)
        s[:, -1:][last] = -1
        take = np.minimum(take[:, :-1], width - 2)
        r, p = np.take_along_axis(r, take, 1), np.take_along_axis(p, take, 1)
        r[:, -1] = _NONE
        for side in (0, 1):
            at = j - side
            ok = np.flatnonzero((at >= 0) & (at < width - 1))
            at = at[ok]
            r[ok, at], p[ok, at] = self._merge_all(s[ok, at], s[ok, at + 1])
        if whole:
            return s, r, p
        symbols[rows], rank[rows], piece[rows] = s, r, p
        return symbols, rank, piece

    def _heap(self, chunk: str, drops: Iterable[int] = ()) -> list[int]:
        """Segment one chunk; ``drops`` are the ordinals, rising, of the candidates to be dropped."""
        coming = iter(drops or ())
        step, drop = 0, next(coming, -1)
        symbols: list[str | None] = list(chunk)
        score, ids, n = self.score, self.ids, len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(score[pair], i, pair) for i in range(n - 1) if (pair := chunk[i : i + 2]) in score and chunk[i] in score and chunk[i + 1] in score]
        heapify(agenda)
        while agenda:
            _, i, pair = heappop(agenda)
            left, j = symbols[i], after[i]
            if left is None or j >= n or len(left) >= len(pair) or left + symbols[j] != pair:
                continue
            step += 1
            if step - 1 == drop:
                drop = next(coming, -1)
                continue
            symbols[i], symbols[j] = pair, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                both = pair + symbols[after[i]]
                if both in score and symbols[after[i]] in score:
                    heappush(agenda, (score[both], i, both))
            if before[i] >= 0:
                both = symbols[before[i]] + pair
                if both in score and symbols[before[i]] in score:
                    heappush(agenda, (score[both], before[i], both))
        out: list[int] = []
        for piece in symbols:
            if piece is not None:
                known = ids.get(piece)
                out += [known] if known is not None else [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]
        return out

    def _bytes_for_odd(self, found: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that are no piece written as the bytes of their characters; ``sizes`` are symbols of each state."""
        odd = np.flatnonzero(found >= self.size)
        if not len(odd):
            return found, sizes
        written = {c: [self.byte[b] for b in chr(c - self.size).encode("utf-8", "surrogatepass")] for c in set(found[odd].tolist())}
        times = np.ones(len(found), np.int64)
        times[odd] = [len(written[c]) for c in found[odd].tolist()]
        out = np.repeat(found, times)
        start = (np.cumsum(times) - times)[odd].tolist()
        for at, c in zip(start, found[odd].tolist(), strict=True):
            out[at : at + len(written[c])] = written[c]
        total = np.concatenate([[0], np.cumsum(times)])
        ends = np.cumsum(sizes)
        return out, total[ends] - total[ends - sizes]

    def _learn(self, at: np.ndarray, sizes: np.ndarray, before: np.ndarray, drops: np.ndarray) -> range:
        """Make states of chunks (ranges of ``symbols``, none too long) that follow from the states ``before`` by ``drops``."""
        n, first = len(at), self.states.shape[1]
        if not n:
            return range(first, first)
        rows, row, past, drop = [np.zeros(0, np.int64)], np.arange(n), before, drops
        steps = [np.zeros(0, np.int64)]
        while len(row := row[past >= 0]):
            past, drop = past[past >= 0], drop[past >= 0]
            rows.append(row)
            steps.append(drop)
            past, drop = self.states[5, past], self.states[6, past]
        dropping, dropped = np.concatenate(rows), np.concatenate(steps)
        tables, flats, start = np.empty((7, n), np.int64), [], len(self.flat)
        group = np.searchsorted(WIDTHS, sizes)
        for g in np.unique(group).tolist():
            members = np.flatnonzero(group == g)
            place = np.full(n, -1)
            for part in np.array_split(members, -(-len(members) // 50_000)):
                own = sizes[part]
                symbols = np.full((len(part), WIDTHS[g]), -1, np.int32)
                column = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
                line = np.repeat(np.arange(len(part)), own)
                symbols[line, column] = self.symbols[np.repeat(at[part], own) + column]
                place[part] = np.arange(len(part))
                mine = place[dropping] >= 0
                ended, took = self._lockstep(symbols, place[dropping[mine]], dropped[mine])
                place[part] = -1
                full = ended >= 0
                flat, count_ = self._bytes_for_odd(ended[full], full.sum(axis=1))
                tables[:3, part] = start + np.cumsum(count_) - count_, count_, took
                start += len(flat)
                flats.append(flat)
        tables[3:] = at, sizes, before, drops
        self.flat = np.concatenate([self.flat, *flats])
        self.states = np.concatenate([self.states, tables], axis=1)
        return range(first, first + n)

    def _draws(self, base: int, most: int) -> Iterator[int]:
        """The steps, up to ``most``, at which candidates of an occurrence are dropped."""
        step = -1
        for r in count(1):
            if step >= most:
                return
            u = _mixed((base + r * _STEP) & _M64)
            passed = bisect_left(self.falling, -u) - 1
            step += passed + (passed < RUN)
            if passed < RUN:
                yield step

    def _drawn(self, chunks: list[str], base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces of all occurrences of chunks in a row, and how many each has; ``base`` seeds their draws."""
        roots = self.roots
        new = [c for c in dict.fromkeys(chunks) if c not in roots and len(c) <= WIDTHS[-1]]
        if new:
            sizes = np.fromiter(map(len, new), np.int64, len(new))
            at = len(self.symbols) + np.cumsum(sizes) - sizes
            self.symbols = np.concatenate([self.symbols, self.symbol[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]])
            none = np.full(len(new), -1)
            roots.update(zip(new, self._learn(at, sizes, none, none), strict=True))
        states = np.fromiter((roots.get(c, -1) for c in chunks), np.int64, len(chunks))
        long = np.flatnonzero(states < 0).tolist()
        if self.limit:
            # From round to round only those stay that drop one more candidate. ``done`` is the first step not yet drawn for.
            at = np.flatnonzero(states >= 0)
            done, r, follow = np.zeros(len(at), np.int64), 0, self.after
            while len(at):
                r += 1
                left = self.states[2, states[at]] - done
                u = np.minimum(_mixed_all(base[at] + np.uint64(r * _STEP & _M64)), np.uint64(_M64 - 1))
                hit = (left > 0) & (u >= self.passes[np.minimum(np.maximum(left, 0), RUN)])
                at, done, u = at[hit], done[hit], u[hit]
                if not len(at):
                    break
                drop = done + len(self.passes) - 1 - np.searchsorted(self.passes[::-1], u, "right")
                pairs, where = np.unique(states[at] << 12 | drop, return_inverse=True)
                after = np.fromiter((follow.get(p, -1) for p in pairs.tolist()), np.int64, len(pairs))
                fresh = np.flatnonzero(after < 0)
                before = pairs[fresh] >> 12
                made = self._learn(self.states[3, before], self.states[4, before], before, pairs[fresh] & 0xFFF)
                after[fresh] = made
                follow.update(zip(pairs[fresh].tolist(), made, strict=True))
                states[at] = after[where]
                done = drop + 1
        starts, sizes, flat = self.states[0, states], self.states[1, states], self.flat
        if long:
            cold: dict[str, list[int]] = {}
            found = []
            for i in long:
                if self.limit:
                    found.append(self._heap(chunks[i], self._draws(int(base[i]), 3 * len(chunks[i]))))
                else:
                    found.append(cold.get(chunks[i]) or cold.setdefault(chunks[i], self._heap(chunks[i])))
            sizes[long] = own = np.array([len(x) for x in found], np.int64)
            starts[long] = len(flat) + np.cumsum(own) - own
            flat = np.concatenate([flat, *(np.array(x, np.int32) for x in found)])
        return flat[np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))], sizes

    def encode_arrays(self, texts: list[str], keys: list[int]) -> list[np.ndarray]:
        """Token ids of each text; what is dropped follows from its key and the place."""
        if self.states.shape[1] > CACHE_STATES:
            self._forget()
        chunks: list[str] = []
        ends = []
        for text in texts:
            for k, part in enumerate(text.split(MARK) if text else []):
                if k:
                    chunks.append("")  # a mark in the text itself
                chunks += _CHUNK.findall((MARK if not k else "") + part.replace(" ", MARK))
            ends.append(len(chunks))
        own = np.diff(np.array([0, *ends], np.int64))
        place = np.arange(len(chunks)) - np.repeat(np.cumsum(own) - own, own)
        key = _mixed_all(np.array([(k + 1) * _STEP & _M64 for k in keys], np.uint64) + np.uint64(self.seed))
        base = _mixed_all(np.repeat(key, own) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(_STEP))
        found, sizes = self._drawn(chunks, base)
        cuts = np.concatenate([[0], np.cumsum(sizes)])[ends]
        return np.split(found, cuts)[: len(texts)]

    def encode_all(self, texts: list[str], keys: list[int]) -> list[list[int]]:
        return [x.tolist() for x in self.encode_arrays(texts, keys)]

    def encode(self, text: str, key: int = 0) -> list[int]:
        return self.encode_all([text], [key])[0]

    def decode(self, ids: list[int]) -> str:
        raw = b"".join(map(self.value.__getitem__, ids))
        return raw[1:].decode("utf-8", "surrogatepass")  # without the mark put in front


def _slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about BATCH_CHARS characters."""
    first = held = 0
    for k, text in enumerate(texts, 1):
        held += len(text)
        if held >= BATCH_CHARS:
            yield first, k
            first, held = k, 0
    if first < len(texts):
        yield first, len(texts)


@cache
def codec(path: str, dropout: float, seed: int) -> Codec:
    return Codec(path, dropout, seed)


def encode_texts(docs: DataFrame, model: str, dropout: float = 0.1, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per row of ``docs``: id, tokens, a digest of the token ids, whether decoding gives the text, the ids.

    ``model`` is the path of a model file that every executor can open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model, dropout, seed)
        for batch in batches:
            counts, digests, fine, all_ids = [], [], [], []
            texts, keys = batch.column("text").to_pylist(), batch.column("key").to_pylist()
            for a, b in _slices(texts):
                for text, ids in zip(texts[a:b], coder.encode_arrays(texts[a:b], keys[a:b]), strict=True):
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    fine.append(coder.decode(ids.tolist()) == text)
                    if with_ids:
                        all_ids.append(ids)
            columns = [batch.column("id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(fine, pa.bool_())]
            names = ["id", "n_tokens", "ids_sha256", "lossless"]
            if with_ids:
                columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    bounded_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(F.lit(seed), F.col(id_col)).alias("key")).mapInArrow(
        tidied(run), f"id {id_type}, n_tokens long, ids_sha256 string, lossless boolean" + ", ids array<int>" * with_ids
    )
    return found.withColumnRenamed("id", id_col)


def decode_ids(tokens: DataFrame, model: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``tokens`` with the decoded text of each row's ids; null ids decode to null."""
    from pyspark.sql.types import StringType, StructType

    schema = StructType([*(f for f in tokens.schema if f.name != out_col)]).add(out_col, StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(model, 0.0, 0)
        for batch in batches:
            texts = [None if ids is None else coder.decode(ids) for ids in batch.column(ids_col).to_pylist()]
            names = [n for n in batch.schema.names if n != out_col]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], [*names, out_col])

    return tokens.mapInArrow(run, schema)

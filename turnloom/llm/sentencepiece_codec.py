"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies with byte fallback.

Encoding is a score-ordered agenda: every adjacent pair of symbols whose join is a piece waits by (score,
place); the best is merged, its new neighbours are entered, and entries whose symbols have changed
meanwhile are dropped. Symbols that end outside the vocabulary become their UTF-8 bytes' pieces. Short
segments are worked off together, their agendas being the rows of one array; long ones have a heap each.

No piece of such a vocabulary has the space mark behind another character, so merges never cross the
place before a run of space marks; texts are cut there and each distinct segment is merged once per
worker (a bounded cache). The constructor tests that property and otherwise merges whole texts.

The cache holds a segment's ids as the bytes of 32-bit numbers: a text's ids are those of its segments joined, and its decimal ids
are joined from a table, so that no number is a Python object.

Checks against the library, in every Arrow batch: each segment that isn't in the worker's cache (TOGETHER of them as one text, where
merges stay within segments), and the longest of each 64 texts as a whole. A difference raises. Decoding is the library's decode(ids).

Scale: one pass over the rows, no shuffle; memory is one Arrow batch and two generations of the cache, which is bounded in segments
of up to 32 characters (a longer one counts as several, so texts without spaces can't fill a worker).

Defined cases: null is encoded as the empty text (no ids); repeated rows, and rows of one id, give a result each; a null id stays null;
texts are encoded whole, however long; an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import bisect
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm import workers
from turnloom.session import spread, text_batches

SPACE = "▁"
CACHE, SHORT, TOGETHER = 300_000, 32, 16
OUTSIDE, GONE, END = 1 << 19, (1 << 21) - 2, (1 << 21) - 1
#: The rank of two symbols that don't join.
NEVER = np.iinfo(np.int32).max


class Agenda:
    """Encoder over a vocabulary given as the library's processor."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = self.lib.get_piece_size()
        normal = [i for i in range(n) if not (self.lib.is_control(i) or self.lib.is_unknown(i) or self.lib.is_byte(i))]
        ids = {self.lib.id_to_piece(i): i for i in normal}
        places = {score: at for at, score in enumerate(sorted({self.lib.get_score(i) for i in normal}, reverse=True))}
        self.id_of = ids
        #: A piece's place in the order of scores, best first.
        self.rank = {p: places[self.lib.get_score(i)] for p, i in ids.items()}
        #: Every id in decimals and a comma, filled up with zero bytes.
        self.digits = np.array([f"{i}," for i in range(n)], "S").view(np.uint8).reshape(n, -1)
        self.byte = [self.lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.whole = any(SPACE in p.lstrip(SPACE) for p in ids)
        self.cut = re.compile(r"(?s).+" if self.whole else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        #: Pairs of symbols that join, as (left << 21 | right), with the joined piece's rank and id.
        #: A symbol is a piece's id, or OUTSIDE + code point for a character that is no piece.
        pairs = {}
        for piece, i in ids.items():
            for cut in range(1, len(piece)):
                left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
                if left is not None and right is not None:
                    pairs[left << 21 | right] = (self.rank[piece], i)
        keys = np.array(sorted(pairs), np.int64)
        ranked = np.array([pairs[k] for k in keys.tolist()], np.int64).reshape(len(keys), 2)
        #: An open hash table of them, small enough for a core's own cache; the last slot stands for pairs that don't join.
        self.bits = max(8, int(len(keys) * 2).bit_length())
        self.slots = np.full((1 << self.bits) + 1, -1, np.int64)
        self.pair_rank = np.full(len(self.slots), NEVER, np.int32)
        self.pair_id = np.zeros(len(self.slots), np.int32)
        self.probes = 0
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            _, first = np.unique(at, return_index=True)
            won = first[self.slots[at[first]] < 0]
            self.slots[at[won]] = keys[left[won]]
            self.pair_rank[at[won]], self.pair_id[at[won]] = ranked[left[won], 0], ranked[left[won], 1]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        self.symbol = np.arange(0x110000, dtype=np.int32) + OUTSIDE
        for piece, i in ids.items():
            if len(piece) == 1:
                self.symbol[ord(piece)] = i
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.limit = CACHE
        self.held = 0

    def merge(self, segment: str) -> bytes:
        symbols: list[str | None] = list(segment)
        n, rank = len(symbols), self.rank.get
        shift = n.bit_length()
        # An agenda entry is (place in score order, left symbol) in one number.
        agenda = [(r << shift) | i for i in range(n - 1) if (r := rank(segment[i : i + 2])) is not None]
        heapq.heapify(agenda)
        after, before, low = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << shift) - 1
        while agenda:
            entry = heapq.heappop(agenda)
            i = entry & low
            left, j = symbols[i], after[i]
            if left is None or j >= n:
                continue
            joined = left + symbols[j]
            if rank(joined) != entry >> shift:
                continue  # one of the two has changed since
            symbols[i], symbols[j] = joined, None
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank(joined + symbols[k])) is not None:
                    heapq.heappush(agenda, (r << shift) | i)
            h = before[i]
            if h >= 0 and (r := rank(symbols[h] + joined)) is not None:
                heapq.heappush(agenda, (r << shift) | h)
        ids: list[int] = []
        id_of = self.id_of.get
        for s in symbols:
            if s is not None:
                known = id_of(s)
                if known is not None:
                    ids.append(known)
                else:
                    ids.extend([self.byte[b] for b in s.encode()])
        return np.array(ids, np.int32).tobytes()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Slots of symbols that join, else the last slot; either may be END."""
        key = left.astype(np.int64) << 21 | right
        at = self._slot(key)
        held = self.slots[at]
        out = np.where(held == key, at, 1 << self.bits)
        again = np.flatnonzero((held != key) & (held >= 0))
        for _ in range(self.probes):
            if not len(again):
                break
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            held = self.slots[at[again]]
            hit = held == key[again]
            out[again[hit]] = at[again[hit]]
            again = again[~hit & (held >= 0)]
        return out

    def merge_all(self, segments: list[str]) -> list[bytes]:
        """merge() of short segments: in every turn each segment's best agenda entry is taken. A row is a segment between two ENDs; a symbol that was merged
        into its left neighbour is GONE, and the others know their neighbours' columns."""
        n, width = len(segments), max(map(len, segments))
        codes = np.frombuffer("".join([x.ljust(width, "\0") for x in segments]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        size = np.array([len(x) for x in segments])
        row = width + 2
        symbols = np.full((n, row), END, np.int32)
        symbols[:, 1:-1] = np.where(np.arange(width) < size[:, None], self.symbol[codes], END)
        pair = np.full((n, row), 1 << self.bits, np.int32)
        pair[:, :-1] = self.pairs(symbols[:, :-1].ravel(), symbols[:, 1:].ravel()).reshape(n, -1)
        agenda = self.pair_rank[pair]
        after, before = np.tile(np.arange(1, row + 1, dtype=np.int32), (n, 1)), np.tile(np.arange(-1, row - 1, dtype=np.int32), (n, 1))
        out, live = [b""] * n, np.arange(n)
        while len(live):
            best = np.argmin(agenda, 1)  # the first of equals is the leftmost
            at = np.arange(0, agenda.size, row) + best
            go = agenda.ravel()[at] < NEVER
            if go.sum() * 4 <= len(live) * 3:
                self._told(symbols[~go], live[~go].tolist(), out)
                symbols, pair, agenda, after, before, live = symbols[go], pair[go], agenda[go], after[go], before[go], live[go]
                continue
            at = at[go]
            base = at - best[go]
            s, p, r, f, b = symbols.ravel(), pair.ravel(), agenda.ravel(), after.ravel(), before.ravel()
            right = base + f[at]
            s[at], s[right], r[right] = self.pair_id[p[at]], GONE, NEVER
            next_, left = base + f[right], base + b[at]
            f[at], b[next_] = f[right], best[go]
            changed = np.concatenate([at, left])
            p[changed] = self.pairs(s[changed], s[np.concatenate([next_, at])])
            r[changed] = self.pair_rank[p[changed]]
        return out

    def _told(self, symbols: np.ndarray, places: list[int], out: list[bytes]) -> None:
        """The ids of ended rows; characters that are no piece become their bytes' pieces."""
        left = (symbols != GONE) & (symbols != END)
        data, ends = symbols[left].tobytes(), np.cumsum(4 * left.sum(1)).tolist()
        for at, low, high in zip(places, [0, *ends], ends):
            out[at] = data[low:high]
        for i in np.flatnonzero((left & (symbols >= OUTSIDE)).any(1)).tolist():
            known = [y for x in symbols[i][left[i]].tolist() for y in ([x] if x < OUTSIDE else [self.byte[b] for b in chr(x - OUTSIDE).encode()])]
            out[places[i]] = np.array(known, np.int32).tobytes()

    def segments(self, text: str) -> list[str]:
        if self.whole or not text or text[0] == " " or "  " in text or SPACE in text or "\0" in text:
            return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []
        return (SPACE + text.replace(" ", "\0" + SPACE)).split("\0")  # every space begins a segment

    def learn(self, segments: set[str]) -> None:
        """Merges segments not in the cache and holds each of them against the library."""
        cost = len(segments) + sum(len(s) // SHORT for s in segments)  # long segments cost by their length
        if self.held + cost > self.limit:
            self.older, self.cache, self.held = self.cache, {}, 0
        self.held += cost
        new = sorted(segments, key=len)
        short = bisect.bisect_right(new, SHORT, key=len)
        for at in range(0, short, 4096):
            part = new[at : min(at + 4096, short)]
            self.cache.update(zip(part, self.merge_all(part)))
        for s in new[short:]:
            self.cache[s] = self.merge(s)
        alone = new if self.whole else [s for s in new if s[-1] == SPACE]  # spaces alone join with those of a next segment
        worded = [] if self.whole else [s for s in new if s[-1] != SPACE]
        parts = [[s] for s in alone if s != SPACE]  # alone, a space mark is the library's empty text
        parts += [worded[at : at + TOGETHER] for at in range(0, len(worded), TOGETHER)]
        for part in parts:
            theirs = self.lib.encode("".join(part)[1:].replace(SPACE, " "), return_type="numpy")
            if b"".join(map(self.cache.__getitem__, part)) != theirs.astype(np.int32, copy=False).tobytes():
                raise AssertionError(f"the library encodes {''.join(part)[:80]!r} otherwise")

    def arrays(self, texts: list[str]) -> Iterator[np.ndarray]:
        """ids of every text."""
        parts = [self.segments(t) for t in texts]
        found = [list(map(self.cache.get, p)) for p in parts]
        holes = [[i for i, x in enumerate(f) if x is None] if None in f else [] for f in found]
        missing = {p[i] for p, h in zip(parts, holes) for i in h}
        for s in [s for s in missing if s in self.older]:
            self.cache[s] = self.older[s]
            self.held += 1 + len(s) // SHORT
            missing.discard(s)
        older = self.older  # the cache may turn over
        if missing:
            self.learn(missing)
        for p, f, h in zip(parts, found, holes):
            for i in h:
                f[i] = self.cache.get(p[i]) or self.older.get(p[i]) or older[p[i]]
            yield np.frombuffer(b"".join(f), np.int32)

    def joined(self, ids: np.ndarray) -> bytes:
        """Decimal ids joined by commas."""
        return self.digits[ids].tobytes().translate(None, b"\0")[:-1]

    def encode_all(self, texts: list[str]) -> Iterator[tuple[list[int], str]]:
        """ids, and ids joined by commas, of every text."""
        for ids in self.arrays(texts):
            yield ids.tolist(), self.joined(ids).decode()

    def encode(self, text: str) -> tuple[list[int], str]:
        return next(self.encode_all([text]))

    def decode(self, ids: list[int] | np.ndarray) -> str:
        return self.lib.decode(ids)


def agenda_for(model: bytes, cache: int) -> Agenda:
    """The worker's encoder for a vocabulary; it outlives tasks, and so do its segments, up to twice ``cache``."""
    agenda = workers.kept(hashlib.sha256(model).hexdigest(), lambda: Agenda(model))
    agenda.limit = cache
    return agenda


def _digest(texts: list[str | None], agenda: Agenda) -> dict:
    out: dict = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    probe = max(range(len(texts)), key=lambda i: len(texts[i] or ""), default=None)
    for i, ids in enumerate(agenda.arrays([t or "" for t in texts])):
        if i == probe and not np.array_equal(ids, agenda.lib.encode(texts[i] or "", return_type="numpy")):
            raise AssertionError(f"the library encodes {(texts[i] or '')[:80]!r} otherwise")
        out["n_tokens"].append(len(ids))
        out["ids_sha256"].append(hashlib.sha256(agenda.joined(ids)).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(agenda.decode(ids).encode()).hexdigest())
    return out


def _each_batch(docs: DataFrame, model: bytes, schema: str, row, cache: int = CACHE) -> DataFrame:
    text_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one vocabulary file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        agenda = agenda_for(shipped.value, cache)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield row(batch.slice(at, 64), agenda)

    return spread(docs).mapInArrow(run, schema)


def encode_digests(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. cache: segments of up to 32 characters in each of a worker's two generations."""

    def row(part: pa.RecordBatch, agenda: Agenda) -> pa.RecordBatch:
        got = _digest(part.column(1).to_pylist(), agenda)
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(got["n_tokens"], pa.int64()), pa.array(got["ids_sha256"]), pa.array(got["decoded_sha256"])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _each_batch(docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text"), model, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, cache)


def encode_ids(docs: DataFrame, model: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids: the encoding itself."""

    def row(part: pa.RecordBatch, agenda: Agenda) -> pa.RecordBatch:
        ids = [i for i, _ in agenda.encode_all([t or "" for t in part.column(1).to_pylist()])]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _each_batch(docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text"), model, "doc_id long, ids array<int>", row)


def decode_ids(encoded: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, ids) to (doc_id, text)."""

    def row(part: pa.RecordBatch, agenda: Agenda) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([agenda.decode(ids or []) for ids in part.column(1).to_pylist()])], ["doc_id", "text"])

    return _each_batch(encoded.select("doc_id", "ids"), model, "doc_id long, text string", row)


def public_model(name: str = "piece_bpe_32k.model") -> bytes:
    """A vocabulary file of the installed public tokenizers, read on the driver and shipped to the workers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()

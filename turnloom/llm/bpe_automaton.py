"""BPE encoding and decoding by a tokenization automaton, for vocabularies whose words end in a marked symbol.

The automaton reads tokens. It starts as one state with a loop for every symbol, and an end that the word-final symbols lead to.
Then the merges are applied one after the other, each by a gadget: for (u, v), the state q that u leads to is copied without its arc v,
u leads to the copy from now on, and uv is a new arc to where v leads, from every state that has an arc u. What is left
accepts exactly the sequences that the merges, applied in order, produce (Berglund, Martens and van der Merwe, "Constructing a BPE
Tokenization DFA", 2024). An arc's target depends on its token alone, so the automaton is stored as a table token -> state and, for every token,
the states that lack it: a copy lacks what its original lacks, so these are ranges of states in the order of a walk through the tree of copies.

A word is encoded from left to right: a trie of the tokens gives all arcs that its characters allow, and as each beginning of a word has
one encoding, exactly one arc arrives at every place. Many words run at once, in arrays. Decoding joins the labels of the ids' arcs.

Words are split off as the vocabulary file says (its normalizer and pattern). Texts of Latin letters and common marks, for which that is
lower case and three classes of characters, are split by one regular expression; all others by the library's own normalizer and splitter.

Scale: the automaton is compiled once on the driver (a second, some 20 MB for 49,000 tokens, fixed by the vocabulary) and broadcast. One pass
over the rows, no shuffle; memory is one Arrow batch and a worker's two generations of encoded words.

Defined cases: null is encoded as the empty text (no ids); a text without words has no ids; repeated rows, and rows of one id, give a
result each; a null id stays null; texts and words are encoded whole, however long; the names of special tokens in a text become their ids, as in the library;
an empty table gives an empty table; other columns play no part. A vocabulary that this doesn't cover raises ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from turnloom.llm import workers
from turnloom.session import spread, text_batches

CACHE, SHORT = 200_000, 48
#: The pattern of the vocabulary files that the quick splitter knows.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def byte_labels() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself where it is one, else the next one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Automaton:
    """States, arcs and trie as arrays, made from token -> id, the merges in order, and the mark of a word's end."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str = "</w>"):
        letters = byte_labels()
        #: A symbol is a byte, or 256 + a byte at a word's end.
        symbols = {c + mark: b + at for at, mark in ((0, ""), (256, end)) for b, c in enumerate(letters)}
        n = max(vocab.values()) + 1
        spelled: list[tuple[int, ...] | None] = [None] * n
        leads = [0] * n
        for token, symbol in symbols.items():
            if token not in vocab:
                raise ValueError(f"the vocabulary lacks the symbol {token!r}")
            spelled[vocab[token]], leads[vocab[token]] = (symbol,), int(symbol > 255)
        # State 0 has all arcs, state 1 is a word's end; every other is a copy of an earlier one without one token more.
        copy_of, lacks = [-1, -1], [set() for _ in range(n)]  # lacks[token]: the states that lost it, their copies not listed
        for a, b in merges:
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if spelled[u] is None or spelled[v] is None or spelled[w] is not None:
                raise ValueError(f"the merge of {a!r} and {b!r} stands before its parts, or makes a token again")
            spelled[w] = spelled[u] + spelled[v]
            q, at = leads[u], leads[u]
            while at > 1 and at not in lacks[v]:
                at = copy_of[at]
            if at in (1, -1) or at in lacks[v]:  # v never follows u, or u is never left over
                leads[w] = -1
                lacks[w] = {0}
                continue
            leads[w] = leads[v]
            copy_of.append(q)
            leads[u] = len(copy_of) - 1
            if u == v:  # a run of u: after the odd one neither u nor uu
                lacks[v].add(leads[u])
                lacks[w] = set(lacks[u])
            else:
                lacks[w] = set(lacks[u])
                lacks[v].add(leads[u])
        self._number(copy_of, lacks, leads)
        self._trie(spelled, [t for t in range(n) if spelled[t] is not None and leads[t] >= 0])
        self.label = [""] * n
        for token, i in vocab.items():
            self.label[i] = token
        self.length = np.array([len(s or ()) for s in spelled], np.int32)
        self.word_end = len(end)

    def _number(self, copy_of: list[int], lacks: list[set[int]], leads: list[int]) -> None:
        """Places of the states that arcs lead to, in an order where a state's copies are a range; and the ranges each token is missing from."""
        used = np.zeros(len(copy_of), np.int64)
        used[[s for s in leads if s >= 0]] = 1
        used[0] = 1
        size = used.copy()
        for s in range(len(copy_of) - 1, 1, -1):  # copies come after their originals
            size[copy_of[s]] += size[s]
        first = np.zeros(len(copy_of), np.int64)
        room = np.zeros(len(copy_of), np.int64)  # the next free place of a state's range
        first[1], room[0] = size[0], used[0]
        for s in range(2, len(copy_of)):
            o = copy_of[s]
            first[s] = room[o]
            room[o] += size[s]
            room[s] = first[s] + used[s]
        self.places = int(size[0] + size[1]) + 1
        self.state = np.array([first[s] if s >= 0 else self.places - 1 for s in leads], np.int64)
        tokens = np.repeat(np.arange(len(lacks)), [len(s) for s in lacks])
        states = np.array([s for each in lacks for s in each], np.int64)
        some = size[states] > 0
        low, high = (tokens * self.places + first[states])[some], (tokens * self.places + first[states] + size[states])[some]
        order = np.argsort(low, kind="stable")
        self.low = np.concatenate(([-1], low[order]))
        self.high = np.concatenate(([-1], high[order]))

    def _trie(self, spelled: list[tuple[int, ...] | None], tokens: list[int]) -> None:
        """Transitions (node * 512 + symbol) -> node in an open hash table, and each node's token or -1."""
        edges: dict[int, int] = {}
        ends = [-1]
        for t in tokens:
            node = 0
            for s in spelled[t]:
                key = node << 9 | s
                node = edges.get(key, len(ends))
                if node == len(ends):
                    edges[key] = node
                    ends.append(-1)
            ends[node] = t
        self.token = np.array(ends, np.int32)
        keys, nodes = np.fromiter(edges, np.int64, len(edges)), np.fromiter(edges.values(), np.int32, len(edges))
        self.bits = (2 * len(keys)).bit_length()
        self.keys, self.node, self.probes = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), 0
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            _, one = np.unique(at, return_index=True)
            one = one[self.keys[at[one]] < 0]
            self.keys[at[one]], self.node[at[one]] = keys[left[one]], nodes[left[one]]
            rest = np.ones(len(left), bool)
            rest[one] = False
            left, at = left[rest], (at[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The nodes reached, or -1."""
        keys = node.astype(np.int64) << 9 | symbol
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.node[at], -1)
        again = np.flatnonzero((held != keys) & (held >= 0))
        while len(again):
            at[again] = (at[again] + 1) & ((1 << self.bits) - 1)
            held = self.keys[at[again]]
            hit = held == keys[again]
            out[again[hit]] = self.node[at[again[hit]]]
            again = again[~hit & (held >= 0)]
        return out

    def _has(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Whether the states have an arc of the tokens."""
        key = token.astype(np.int64) * self.places + state
        return key >= self.high[np.searchsorted(self.low, key, "right") - 1]

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's begin (one place more than words). No word is empty."""
        size = np.array([len(w) for w in words], np.int64)
        stop = np.cumsum(size)
        start = stop - size
        text = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        text[stop - 1] += 256
        # Arcs of the lattice: from every place, every token that the following symbols spell; none goes past a word's final symbol.
        place, node = np.arange(len(text)), np.zeros(len(text), np.int32)
        came, tokens = [], []
        depth = 0
        while len(place):
            node = self._step(node, text[place + depth])
            on = node >= 0
            place, node = place[on], node[on]
            token = self.token[node]
            some = np.flatnonzero(token >= 0)
            came.append(place[some])
            tokens.append(token[some])
            depth += 1
            on = place + depth < len(text)
            place, node = place[on], node[on]
        came, tokens = np.concatenate(came), np.concatenate(tokens)
        # Places are worked off by their distance from the word's beginning, a long word's alone.
        word = np.repeat(np.arange(len(words)), size)
        ahead = np.arange(len(text)) - start[word]
        long = size > SHORT
        turn = np.where(long[word], SHORT + np.arange(len(text)), ahead)
        order = np.argsort(turn[came], kind="stable")
        came, tokens = came[order], tokens[order]
        cut = np.flatnonzero(np.diff(turn[came], prepend=-1))
        target = came + self.length[tokens]
        # state[i]: where the encoding of a word's beginning before place i leads; by[i]: the token that arrives before place i.
        state, by = np.zeros(len(text) + 1, np.int64), np.full(len(text) + 1, -1, np.int64)
        begins = np.zeros(len(text) + 1, bool)
        begins[start] = True
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(came)]):
            i, t, j = came[a:b], tokens[a:b], target[a:b]
            new = by[j] < 0
            i, t, j = i[new], t[new], j[new]
            fits = self._has(np.where(begins[i], 0, state[i]), t)
            j, t = j[fits], t[fits]
            by[j], state[j] = t, self.state[t]
        # Back from the ends.
        at, who, back, whose = stop.copy(), np.arange(len(words)), [], []
        while len(who):
            t = by[at]
            back.append(t)
            whose.append(who)
            at = at - self.length[t]
            more = at > start[who]
            at, who = at[more], who[more]
        back, whose = np.concatenate(back[::-1]), np.concatenate(whose[::-1])
        order = np.argsort(whose, kind="stable")
        return back[order], np.concatenate(([0], np.cumsum(np.bincount(whose, minlength=len(words)))))


class Splitter:
    """A text's words, lower-cased, and its special tokens, as the library splits them."""

    def __init__(self, spec: dict):
        from tokenizers import Regex, normalizers, pre_tokenizers

        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        pattern = (steps[0].get("pattern") or {}).get("Regex")
        split = len(steps) == 2 and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and pattern is not None
        if not (split and steps[1]["type"] == "ByteLevel" and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"]):
            raise ValueError("words must be what a pattern matches, in bytes")
        if (spec.get("normalizer") or {}).get("normalizers") != NORMALIZERS or pattern != PATTERN:
            raise ValueError("the vocabulary's normalizer or pattern of words is not one that is known")
        self.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Replace(Regex("\\s+"), " "), normalizers.Lowercase()])
        self.pieces = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])):
            raise ValueError("special tokens must be matched as they stand")
        self.mark = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        # Characters that no normalizer changes but for the case, and whose case stays among them.
        self.plain = re.compile("[\0-įı-ſ‐-‧‰-⁞₠-₿]*")
        kinds = [(c, unicodedata.category(c)[0]) for c in map(chr, range(0x180))]
        letters, numbers = (re.escape("".join(c for c, k in kinds if k == kind)) for kind in "LN")
        self.word = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^\t-\r \x85\xa0{letters}{numbers}]+")

    def words(self, text: str) -> list[str]:
        if self.plain.fullmatch(text):
            return self.word.findall(text.lower())
        return [w for w, _ in self.pieces.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def split(self, text: str) -> list[str | int]:
        """Words, and ids of special tokens."""
        if self.mark is None or not self.mark.search(text):
            return self.words(text)
        out: list[str | int] = []
        for part in self.mark.split(text):
            out += [self.special[part]] if part in self.special else self.words(part)
        return out


class Encoder:
    """A worker's encoder: splitter, automaton, and the ids and labels of words met before, as text."""

    def __init__(self, spec: dict, automaton: Automaton, cache: int = CACHE):
        self.splitter, self.automaton, self.limit = Splitter(spec), automaton, cache
        self.fixed = {i: (str(i), content) for content, i in self.splitter.special.items()}
        self.known: dict = dict(self.fixed)
        self.older: dict = {}

    def _learn(self, words: list[str]) -> dict[str, tuple[str, str]]:
        if not words:
            return {}
        ids, at = self.automaton.encode([w.encode() for w in words])
        labels = list(map(self.automaton.label.__getitem__, ids.tolist()))
        text, cut = list(map(str, ids.tolist())), at.tolist()
        return {w: (" ".join(text[a:b]), " ".join(labels[a:b])) for w, a, b in zip(words, cut, cut[1:])}

    def encode_all(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """Every text's ids and labels, joined by spaces."""
        parts = [self.splitter.split(t) for t in texts]
        missing = set().union(*parts).difference(self.known)
        again = [w for w in missing if w in self.older]
        if len(self.known) + len(missing) > self.limit:
            self.older, self.known = self.known, dict(self.fixed)
            missing = set().union(*parts).difference(self.known)
            again = [w for w in missing if w in self.older]
        self.known.update((w, self.older[w]) for w in again)
        missing.difference_update(again)
        found = {}
        new = sorted(missing, key=len)
        for at in range(0, len(new), 16384):
            found.update(self._learn(new[at : at + 16384]))
        self.known.update((w, x) for w, x in found.items() if len(w) <= SHORT)
        extra = {w: x for w, x in found.items() if len(w) > SHORT}  # long words are not kept
        for p in parts:
            got = [self.known[w] if w in self.known else extra[w] for w in p] if extra else list(map(self.known.__getitem__, p))
            yield " ".join([x for x, _ in got]), " ".join([x for _, x in got])


def encoder_for(key: str, shipped, cache: int) -> Encoder:
    """The worker's encoder for a vocabulary (a broadcast of compiled()); it outlives tasks."""
    encoder = workers.kept(key, lambda: Encoder(*shipped.value, cache))
    encoder.limit = cache
    return encoder


def compiled(vocabulary: bytes) -> tuple[dict, Automaton]:
    """What a vocabulary file says besides its model, and its automaton."""
    spec = json.loads(vocabulary)
    model = spec.pop("model")
    odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    if model["type"] != "BPE" or odd or not model.get("end_of_word_suffix") or spec.get("decoder"):
        raise ValueError(f"not a plain BPE vocabulary with marked ends of words: {odd or model['type']}")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    return spec, Automaton(model["vocab"], merges, model["end_of_word_suffix"])


def _each_slice(docs: DataFrame, vocabulary: bytes, schema: str, row, cache: int) -> DataFrame:
    text_batches(docs.sparkSession)
    key = hashlib.sha256(vocabulary).hexdigest()
    shipped = docs.sparkSession.sparkContext.broadcast(compiled(vocabulary))  # its size is the vocabulary's

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(key, shipped, cache)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                yield row(batch.slice(at, 256), encoder)

    return spread(docs).mapInArrow(run, schema)


def _columns(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"`{text}` text")


def encode_digests(docs: DataFrame, vocabulary: bytes, doc_id: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. cache: words in each of a worker's two generations."""

    def row(part: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        n, ids_sha, text_sha = [], [], []
        for ids, decoded in encoder.encode_all([t or "" for t in part.column(1).to_pylist()]):
            n.append(ids.count(" ") + 1 if ids else 0)
            ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
            text_sha.append(hashlib.sha256(decoded.encode()).hexdigest())
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _each_slice(_columns(docs, doc_id, text), vocabulary, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", row, cache)


def encode_ids(docs: DataFrame, vocabulary: bytes, doc_id: str = "doc_id", text: str = "text", cache: int = CACHE) -> DataFrame:
    """doc_id, ids: the encoding itself."""

    def row(part: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        ids = [[int(i) for i in x.split()] for x, _ in encoder.encode_all([t or "" for t in part.column(1).to_pylist()])]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _each_slice(_columns(docs, doc_id, text), vocabulary, "doc_id long, ids array<int>", row, cache)


def decode_ids(encoded: DataFrame, vocabulary: bytes) -> DataFrame:
    """(doc_id, ids) to (doc_id, text): the labels of the ids' arcs, joined by spaces; ids without a label are passed over."""

    def row(part: pa.RecordBatch, encoder: Encoder) -> pa.RecordBatch:
        label = dict(enumerate(encoder.automaton.label)) | {i: content for content, i in encoder.splitter.special.items()}
        texts = [" ".join([label[i] for i in ids or [] if label.get(i)]) for ids in part.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return _each_slice(encoded.select("doc_id", "ids"), vocabulary, "doc_id long, text string", row, CACHE)


def public_vocabulary(name: str = "word_bpe_49k.json") -> bytes:
    """A vocabulary file of the installed public tokenizers, read on the driver and shipped to the workers."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()

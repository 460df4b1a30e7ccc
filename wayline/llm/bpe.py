"""BPE encoding and decoding by a tokenization automaton.

The automaton's states are tokens (the last one read) and its arcs are labelled with tokens. It starts with one
arc for every pair of bytes. Each merge (u, v), in order, adds a gadget: the label uv goes wherever u went with
v to follow, it leads to a copy of v's state, and the state of u loses its arc v. A sequence of tokens is the
encoding of its text exactly if it is a path. The copies share what they copy: a state keeps when it was made, of which, and which
arcs it lost since; with some 50,000 tokens, arcs written out would number billions.

Labels are read byte by byte through a table of transitions (a trie of all labels). Arcs are deterministic, so every prefix of a word has one
path, and encoding a word walks forward from each of its positions once. Texts are split and encoded many at a time as arrays of code points:
each distinct word of a batch is encoded once. Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "n_tokens long, ids_sha256 string, decoded_sha256 string"
#: The split of byte-level BPE, with white space as Unicode defines it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words whose encodings a worker remembers; it starts afresh beyond that.
REMEMBERED = 400_000


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, other bytes follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TokenAutomaton:
    def __init__(self, spec: dict):
        if spec.get("normalizer") or spec["model"].get("ignore_merges") or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level BPE files are read")
        letters = byte_alphabet()
        raw = {t: bytes(map(letters.__getitem__, t)) for t in spec["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.labels = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.born = {i: -1 for b, i in self.ids.items() if len(b) == 1}
        self.parts: dict[int, tuple[int, int]] = {}
        self.lost: dict[tuple[int, int], int] = {}
        for at, merge in enumerate(spec["model"]["merges"]):
            u, v = merge.split(" ") if isinstance(merge, str) else merge
            self._gadget(at, self.ids[raw[u]], self.ids[raw[v]], self.ids[raw[u] + raw[v]])
        self.goto, self.label = self._labels()
        self._arcs: dict[int, bool] = {}

    def _labels(self) -> tuple[dict[int, int], list[int]]:
        """Transitions (node * 256 + byte to node) through the labels' bytes, and the token that ends in each node, or -1."""
        goto, label = {}, [-1]
        for text, token in self.ids.items():
            node = 0
            for byte in text:
                node = goto.setdefault(node << 8 | byte, len(label))
                if node == len(label):
                    label.append(-1)
            label[node] = token
        return goto, label

    def _gadget(self, at: int, u: int, v: int, uv: int) -> None:
        self.born.setdefault(uv, at)
        self.parts.setdefault(uv, (u, v))
        self.lost.setdefault((u, v), at)

    def arc(self, state: int, label: int) -> bool:
        """Whether the finished automaton has an arc ``label`` in ``state``; found once through the gadgets, then kept in a table."""
        known = self._arcs.get(state << 32 | label)
        if known is None:
            if len(self._arcs) > 4 * REMEMBERED:
                self._arcs.clear()
            known = self._arcs[state << 32 | label] = self._derive(state, label)
        return known

    def _derive(self, state: int, label: int) -> bool:
        """Goes back through the gadgets that made the state or the label, the younger first, up to two bytes."""
        until = len(self.lost) + 1
        while self.lost.get((state, label), until) >= until:
            if self.born[state] > self.born[label]:
                until, state = self.born[state], self.parts[state][1]
            elif label in self.parts:
                until, label = self.born[label] + 1, self.parts[label][0]  # its own gadget merges the leftmost pair first
            else:
                return True
        return False

    def word(self, data: bytes) -> list[int]:
        """The tokens of one pre-split word."""
        n = len(data)
        last, came = [-1] * (n + 1), [0] * (n + 1)
        goto, label, arc = self.goto.get, self.label, self.arc
        for start in range(n):
            state, node = last[start], 0
            for end in range(start, n):
                node = goto(node << 8 | data[end])
                if node is None:
                    break
                token = label[node]
                if token >= 0 and last[end + 1] < 0 and (not start or arc(state, token)):
                    last[end + 1], came[end + 1] = token, start
            if last[n] >= 0:
                break
        out, end = [], n
        while end:
            out.append(last[end])
            end = came[end]
        return out[::-1]


SPACE, LETTER, NUMBER, OTHER, BORDER = range(5)
#: Stands between texts of a batch; no code point.
_BORDER = 0x110000
#: Code points that are taken at once; a text with more goes word by word.
BATCH_POINTS = 400_000


def point_classes() -> np.ndarray:
    """The class of every code point, as ``SPLIT`` sees it."""
    every = [*range(0xD800), *range(0xE000, 0x110000)]
    text = "".join(map(chr, every))
    points = np.array(every)
    out = np.full(0x110001, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
        for m in regex.finditer(pattern, text):
            out[points[m.start() : m.end()]] = kind
    out[_BORDER] = BORDER
    return out


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the words that ``SPLIT`` finds begin, as a mask; texts end in a border each."""
    start = np.ones(len(points), bool)
    start[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == BORDER)
    # the last blank of a run goes with the word behind it if it is a plain one, else it stands alone
    behind = np.flatnonzero((kinds[1:] != kinds[:-1]) & (kinds[:-1] == SPACE) & (kinds[1:] != BORDER)) + 1
    start[behind - 1] = True
    start[behind[points[behind - 1] == 32]] = False
    # a lone apostrophe that begins a word takes the endings of contractions
    quote = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kinds[1:] == LETTER))
    one = points[quote + 1]
    two = points[np.minimum(quote + 2, len(points) - 1)]
    short = (one == 115) | (one == 116) | (one == 109) | (one == 100)
    long = ((two == 101) & ((one == 114) | (one == 118))) | ((one == 108) & (two == 108))
    for ending, own in ((1, quote[short]), (2, quote[long & ~short])):
        start[own + 1] = False
        after = own + 1 + ending
        after = after[after < len(points)]
        start[after[kinds[after] == LETTER]] = True
    return start


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers begin, begin + 1, ... of all ranges, one range after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins - (ends - sizes), sizes)


class Codec:
    """Encodes whole texts to little-endian 32-bit ids and decodes them."""

    def __init__(self, automaton: TokenAutomaton):
        self.automaton = automaton
        self.split = regex.compile(SPLIT).findall
        codec = self

        class Known(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= REMEMBERED:
                    self.clear()
                ids = codec.automaton.word(word.encode("utf-8"))
                made = self[word] = struct.pack(f"<{len(ids)}I", *ids)
                return made

        self.known = Known()
        self.kinds, self.powers = point_classes(), np.zeros(0, np.uint64)
        labels = [automaton.labels.get(i, b"") for i in range(max(automaton.labels) + 1)]
        sizes = np.array(list(map(len, labels)))
        self.emitted = (np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(labels), np.uint8))

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        a = self.automaton
        if not a.specials or not a.specials.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in a.specials.finditer(text):
            out += [self._plain(text[at : m.start()]), np.array([a.special[m[0]]], "<u4").tobytes()]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Equal words are found by a 64-bit hash of their code points and compared with each other before they share an encoding."""
        out: list[np.ndarray | None] = [None] * len(texts)
        batch, size = [], 0
        for i, t in enumerate(texts):
            special = self.automaton.specials is not None and self.automaton.specials.search(t) is not None
            if special or len(t) > BATCH_POINTS:
                out[i] = np.frombuffer(self.encode(t), "<u4")
                continue
            if batch and size + len(t) > BATCH_POINTS:
                self._encode_batch(texts, batch, out)
                batch, size = [], 0
            batch.append(i)
            size += len(t) + 1
        if batch:
            self._encode_batch(texts, batch, out)
        return out

    def _encode_batch(self, texts: list[str], batch: list[int], out: list) -> None:
        sizes = np.array([len(texts[i]) for i in batch])
        points = np.full(int(sizes.sum()) + len(batch), _BORDER, np.int32)
        ends = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(points), bool)
        inside[ends] = False
        text = "".join([texts[i] for i in batch])
        points[inside] = np.frombuffer(text.encode("utf-32-le"), "<i4")
        starts = np.flatnonzero(word_starts(points, self.kinds[points]))
        lengths = np.diff(starts, append=len(points))
        place = _spread(np.zeros(len(starts), np.int64), lengths)
        hashes = np.add.reduceat((points.astype(np.uint64) + np.uint64(77)) * self._powers(int(lengths.max()))[place], starts)
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        same = lengths == lengths[first][number]
        if not same.all() or (points[_spread(starts[first][number], lengths)] != points).any():
            for i in batch:  # two words with one hash
                out[i] = np.frombuffer(self.encode(texts[i]), "<u4")
            return
        # strings of the distinct words, a border being none
        at = starts[first]
        border, at = points[at] == _BORDER, at - np.searchsorted(ends, at)
        known = [b"" if b else self.known[text[a : a + n]] for a, n, b in zip(at.tolist(), lengths[first].tolist(), border.tolist())]
        counts = np.array([len(k) // 4 for k in known])
        table = np.frombuffer(b"".join(known), "<u4")
        ids = table[_spread((np.cumsum(counts) - counts)[number], counts[number])]
        upto = np.cumsum(counts[number])[np.searchsorted(starts, ends)]
        for i, a, b in zip(batch, [0, *upto[:-1].tolist()], upto.tolist()):
            out[i] = ids[a:b]

    def _powers(self, n: int) -> np.ndarray:
        if len(self.powers) < n:
            self.powers = np.cumprod(np.full(2 * n, 0x9E3779B97F4A7C15, np.uint64), dtype=np.uint64)
        return self.powers

    def decode(self, ids: bytes | np.ndarray) -> str:
        """The labels of the arcs, one after the other."""
        ids = np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids
        if not len(ids):
            return ""
        begins, sizes, text = self.emitted
        return text[_spread(begins[ids], sizes[ids])].tobytes().decode("utf-8", "replace")


def load(spec_json: str) -> Codec:
    return Codec(TokenAutomaton(json.loads(spec_json)))


_READY: dict[str, Codec] = {}


def _codec(shared) -> Codec:
    """One codec in each Python worker: built on first use, kept for later tasks."""
    text = shared.value
    key = hashlib.sha256(text.encode()).hexdigest()
    if key not in _READY:
        _READY.clear()
        _READY[key] = load(text)
    return _READY[key]


def _digests(shared):
    @F.pandas_udf(SCHEMA)
    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec, sha = _codec(shared), hashlib.sha256
        for texts in batches:
            rows = []
            for ids in codec.encode_all([t or "" for t in texts]):
                rows.append((len(ids), sha(ids.astype("<u4").tobytes()).hexdigest(), sha(codec.decode(ids).encode("utf-8")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digest


def _share(spark: SparkSession, vocabulary: str):
    """The vocabulary file's text as a broadcast (a fixed file of one or two MB); executors need not see the path."""
    with open(vocabulary, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), the whole text's tokens. A null text has none."""
    shared = _share(docs.sparkSession, vocabulary)

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for texts in batches:
            yield pd.Series([ids.astype("int32") for ids in codec.encode_all([t or "" for t in texts])])

    return docs.withColumn("ids", run(F.col(text_col)))


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of their ids (null ids: an empty text)."""
    shared = _share(rows.sparkSession, vocabulary)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(shared)
        for ids in batches:
            yield pd.Series([codec.decode(np.asarray([] if x is None else x, "<u4")) for x in ids])

    return rows.withColumn("decoded", run(F.col(ids_col)))


def round_trip(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``docs`` with a struct ``bpe``: the token count and the digests of the ids and of the decoded text.

    A null text is an empty one with no tokens. Each row stands for itself: repeated rows give equal results, a text of any length is encoded whole,
    an empty table gives none, and other columns pass through; one named ``bpe`` is replaced.
    """
    return docs.withColumn("bpe", _digests(_share(docs.sparkSession, vocabulary))(F.col(text_col)))

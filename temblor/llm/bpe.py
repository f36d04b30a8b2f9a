"""BPE encoding and decoding by an automaton over token sequences.

``compile_merges`` starts from one state in which every base token leads back
to itself, and applies the merges in order. The merge of u and v to w is a
gadget: u gets a state of its own from which v is no longer allowed, every
state with an arc u gets an arc w, and w leads where v led before. In the end
the accepted token sequences are exactly those that merging would produce, and
each word has one accepted sequence, which is found from left to right by
table look-ups. A token's arc label is its byte string; decoding joins labels.

Texts are split into words first, as the tokenizer file asks (byte-level
splitting; special tokens in a text stand alone). Tasks keep words already
encoded in a bounded table. The automaton is as large as the vocabulary makes
it and is broadcast; its size does not depend on the input.

Defined cases: a null text is encoded like an empty one, to no tokens; equal
rows give equal results; further columns are carried by ``encode`` and
``decode``, and replaced where they have the name of a result. Bytes that are no UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of byte-level BPE: the word pattern, and the bytes that stand for themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same words in ASCII texts, which the plainer engine splits faster.
ASCII_PATTERN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\x09-\x0D\x20A-Za-z0-9]+"
                           r"|[\x09-\x0D\x20]+(?![^\x09-\x0D\x20])|[\x09-\x0D\x20]+")
SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Words a task remembers at most; beyond that it starts a new table.
WORDS_KEPT = 400_000
#: Words longer than this are encoded but not remembered.
LONG_WORD = 64


def byte_of_char() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary."""
    hidden = [b for b in range(256) if b not in set(SHOWN)]
    return {chr(b): b for b in SHOWN} | {chr(256 + k): b for k, b in enumerate(hidden)}


def compile_merges(base: list[int], merges: list[tuple[int, int, int]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Arcs (packed bits, [token // 8, state]) and the state each token leads to.

    ``base`` are the tokens without a merge, ``merges`` triples (u, v, w) in
    order, ``size`` the number of token ids. Tokens no merge can reach keep
    state -1 and have no arcs.
    """
    rows = (size + 7) // 8
    arcs = np.zeros((rows, 1024), dtype=np.uint8)
    leads = np.full(size, -1, dtype=np.int32)
    for token in base:
        leads[token] = 0
        arcs[token >> 3, 0] |= 1 << (token & 7)
    users = [len(base) + 1]  # the first state is also where words begin
    states = 1
    for u, v, w in merges:
        if leads[w] >= 0:
            raise ValueError(f"two merges make token {w}")
        here = leads[u]
        if here < 0 or leads[v] < 0 or not arcs[v >> 3, here] >> (v & 7) & 1:
            continue
        if u == v:  # w goes on from the old state, in which u is still allowed
            leads[w] = here
            users[here] += 1
        else:
            leads[w] = leads[v]
            users[leads[v]] += 1
        if users[here] > 1:
            if states == arcs.shape[1]:
                arcs = np.concatenate([arcs, np.zeros_like(arcs)], axis=1)
            arcs[:, states] = arcs[:, here]
            users[here] -= 1
            users.append(1)
            here = leads[u] = states
            states += 1
        arcs[v >> 3, here] &= 0xFF ^ (1 << (v & 7))
        can = arcs[u >> 3, :states] >> (u & 7) & 1
        arcs[w >> 3, :states] |= can << (w & 7)
    return arcs[:, :states], leads


class Automaton:
    """Compiled merges with the arc labels; encodes texts and decodes ids."""

    def __init__(self, arcs: np.ndarray, leads: np.ndarray, labels: list[bytes], special: dict[str, int]):
        self.arcs, self.labels, self.special = arcs, labels, special
        self.flat, self.states = memoryview(np.ascontiguousarray(arcs)).cast("B"), arcs.shape[1]
        self.leads = leads.tolist()
        self.ids = {label: k for k, label in enumerate(labels) if label and leads[k] >= 0}
        self.longest = max(map(len, self.ids), default=1)
        #: Of each label the token, its row and bit among the arcs, the state it leads to, and its length.
        self.arcs_of = {label: (k, (k >> 3) * self.states, 1 << (k & 7), self.leads[k], len(label))
                        for label, k in self.ids.items()}
        self._ready = None

    @classmethod
    def from_file(cls, path: str) -> Automaton:
        """Read a tokenizers JSON file with a byte-level BPE model."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, real = spec["model"], byte_of_char()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"]:
            raise ValueError("the file holds no plain byte-level BPE")
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        vocab = model["vocab"]
        size = max([*vocab.values(), *special.values()]) + 1
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        made = {w for _, _, w in merges}
        base = [k for token, k in vocab.items() if k not in made and len(token) == 1]
        labels = [b""] * size
        for token, k in vocab.items():
            labels[k] = bytes(real[c] for c in token)
        arcs, leads = compile_merges(base, merges, size)
        for token, k in special.items():
            labels[k] = token.encode("utf-8")
            leads[k] = -1
        return cls(arcs, leads, labels, special)

    def pack(self) -> bytes:
        head = json.dumps({"shape": self.arcs.shape, "labels": [x.hex() for x in self.labels],
                           "special": self.special, "leads": self.leads}).encode()
        return zlib.compress(len(head).to_bytes(8, "little") + head + np.ascontiguousarray(self.arcs).tobytes(), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Automaton:
        raw = zlib.decompress(data)
        size = int.from_bytes(raw[:8], "little")
        head = json.loads(raw[8:8 + size])
        arcs = np.frombuffer(raw, dtype=np.uint8, offset=8 + size).reshape(head["shape"])
        return cls(arcs, np.array(head["leads"]), [bytes.fromhex(x) for x in head["labels"]], head["special"])

    def word(self, data: bytes) -> tuple[int, ...]:
        """The one accepted token sequence that spells ``data``."""
        whole = self.ids.get(data)
        if whole is not None and self.flat[(whole >> 3) * self.states] >> (whole & 7) & 1:
            return (whole,)
        # From the end, longest tokens first; where a token begins is looked at only if one fits there.
        flat, known, longest = self.flat, self.arcs_of.get, self.longest
        found = [None] * (len(data) + 1)
        found[0] = (-1, 0, 0, 0, 0)
        at = [end - longest if end > longest else 0 for end in range(len(data) + 1)]
        todo = [len(data)]
        while todo:
            end = todo[-1]
            for begin in range(at[end], end):
                arc = known(data[begin:end])
                if arc is None:
                    continue
                before = found[begin]
                if before is None:
                    at[end] = begin
                    todo.append(begin)
                    break
                if flat[arc[1] + before[3]] & arc[2]:
                    found[end] = arc
                    todo.pop()
                    break
            else:
                if end:
                    raise ValueError("a byte of the text is missing in the vocabulary")
                todo.pop()
        tokens, end = [], len(data)
        while end:
            tokens.append(found[end][0])
            end -= found[end][4]
        return tuple(tokens[::-1])

    def _tools(self):
        if self._ready is None:
            import regex

            stops = sorted(self.special, key=len, reverse=True)
            self._ready = (regex.compile(PATTERN), regex.compile("(" + "|".join(map(regex.escape, stops)) + ")")
                           if stops else None, _Words(self))
        return self._ready

    def _split(self, text: str) -> list[str]:
        """Words of a text."""
        return (ASCII_PATTERN if text.isascii() else self._tools()[0]).findall(text)

    def encode(self, text: str | None) -> list[int]:
        """Token ids of a whole text."""
        if not text:
            return []
        _, stops, words = self._tools()
        if stops is None or not any(x in text for x in self.special):
            return list(chain.from_iterable(map(words.__getitem__, self._split(text))))
        found: list[int] = []
        for part in stops.split(text):
            if part in self.special:
                found.append(self.special[part])
            else:
                found.extend(chain.from_iterable(map(words.__getitem__, self._split(part))))
        return found

    def decode(self, ids: Iterable[int]) -> str:
        """Arc labels of the ids, joined and read as UTF-8."""
        return b"".join(map(self.labels.__getitem__, ids)).decode("utf-8", "replace")


class _Words(dict):
    """Encoded words; unknown ones are looked up in the automaton."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = self.automaton.word(word.encode("utf-8"))
        if len(word) <= LONG_WORD:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = found
        return found


_compiled: dict[str, bytes] = {}
_loaded: dict[int, Automaton] = {}


def compiled(path: str) -> bytes:
    """The packed automaton of a tokenizer file, compiled once per driver."""
    if path not in _compiled:
        _compiled[path] = Automaton.from_file(path).pack()
    return _compiled[path]


def _on_task(shared) -> Automaton:
    """The broadcast automaton, unpacked once per worker."""
    if shared.id not in _loaded:
        _loaded.clear()
        _loaded[shared.id] = Automaton.unpack(shared.value)
    return _loaded[shared.id]


class _Shared:
    """A broadcast value with an id that survives pickling."""

    def __init__(self, spark, data: bytes):
        self.data = spark.sparkContext.broadcast(data)
        self.id = hashlib.sha1(data).hexdigest()

    @property
    def value(self) -> bytes:
        return self.data.value


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids of each whole text as an array of ints."""
    shared = _Shared(docs.sparkSession, compiled(path))

    @F.pandas_udf("array<int>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _on_task(shared)
        for part in texts:
            yield part.map(automaton.encode)

    return docs.withColumn(out, run(F.coalesce(F.col(text), F.lit(""))))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the text that an array of token ids stands for; null ids are no tokens."""
    shared = _Shared(docs.sparkSession, compiled(path))

    @F.pandas_udf("string")
    def run(arrays: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = _on_task(shared)
        for part in arrays:
            yield part.map(automaton.decode)

    return docs.withColumn(out, run(F.coalesce(F.col(ids), F.array().cast("array<int>"))))


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode each text in one pass over the data.

    Gives id, ``n_tokens``, and the SHA-256 of the ids (decimal, joined by
    commas) and of the decoded text.
    """
    shared = _Shared(docs.sparkSession, compiled(path))

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _on_task(shared)
        digits = [str(k) for k in range(len(automaton.labels))]
        for part in texts:
            rows = []
            for body in part:
                ids = automaton.encode(body)
                rows.append((len(ids), hashlib.sha256(",".join(map(digits.__getitem__, ids)).encode()).hexdigest(),
                             hashlib.sha256(automaton.decode(ids).encode("utf-8")).hexdigest()))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    done = docs.select(F.col(id_col), run(F.coalesce(F.col(text), F.lit(""))).alias("done"))
    return done.select(id_col, "done.*")

"""Spelling variants: words one edit apart, found in bidirectional FM-indexes.

Two words one inserted, deleted or replaced code point apart agree in the left
or in the right half of either. So a word is searched twice: one half must match
exactly up to the delimiter, then the match is extended across the other half
with one error. Searches run on intervals of suffix ranks of the words of a shard,
written one after the other between delimiters; both the text and its reverse have
a rank table, so an interval can grow to the left and to the right. All searches
of a shard advance together, one symbol at a time.

Words meet by the exact half: each is indexed under the halves that words one
shorter, as long, or one longer would ask for, two at most on each side. Halves
are packed into shards of bounded size; the words of a half that is more than a
shard are dealt out, and their searches go to each part. A pair that both
halves would find counts on the left side only, so counts from all shards add up.

Defined cases: null and empty texts have no words; a null id is hashed like an empty
string; repeated rows count as often as they are there; words of any length are
whole; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from temblor.session import materialize

LEAST_CHARS, LEAST_COUNT, FACTOR, DELETE_ONE_IN = 6, 5, 5, 199
#: Words indexed in a shard, on average; a half with more of them is dealt out.
SHARD = 8_000
#: Different words a task counts before it hands them on.
COUNTED = 200_000
#: Crowded halves that are broadcast at most; beyond that they are joined.
MOST_BROADCAST = 100_000
#: The terminator and the delimiter of the indexed text; letters follow.
END, DELIMITER = 0, 1
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                one_in: int = DELETE_ONE_IN) -> DataFrame:
    """``word, n`` of all runs of Latin letters; one run in ``one_in`` loses a code point by its hash."""
    runs = re.compile(f"[A-Za-zÀ-ÿ]{{{least_chars},}}")

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[str, int] = {}

        def out() -> pd.DataFrame:
            rows = pd.DataFrame({"word": pd.Series(list(found), dtype=object), "n": list(found.values())})
            found.clear()
            return rows

        for frame in frames:
            for key, body in zip(frame["key"], frame["body"]):
                head = zlib.crc32(f"{key}:".encode())
                for run, n in Counter(runs.findall(body)).items():
                    word = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(word.encode(), head)
                    if h % one_in == 0:
                        cut = h % len(word)
                        word = word[:cut] + word[cut + 1:]
                        if len(word) < least_chars:
                            continue
                    found[word] = found.get(word, 0) + n
                if len(found) >= COUNTED:
                    yield out()
        if found:
            yield out()

    bodies = docs.where(F.col(f"`{text}`").isNotNull()).select(
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("body"))
    return bodies.mapInPandas(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def suffix_ranks(codes: np.ndarray, bits: int) -> np.ndarray:
    """Suffix array of codes below ``2 ** bits`` whose last one is the only least one."""
    size, known = len(codes), 62 // bits
    key = np.zeros(size, dtype=np.int64)
    padded = np.concatenate([codes, np.zeros(known, dtype=np.int64)])
    for k in range(known):
        key = key << bits | padded[k:k + size]
    while True:
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[False], np.diff(key[order]) != 0])
        rank = np.empty(size, dtype=np.int64)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == size - 1:
            return order
        key = rank * (size + 1)
        key[:size - known] += rank[known:] + 1
        known *= 2


class Half:
    """Rank tables of a text: intervals grow by a symbol in front."""

    def __init__(self, codes: np.ndarray, symbols: int):
        self.order = suffix_ranks(codes, max(1, (symbols - 1).bit_length()))
        before = codes[self.order - 1]
        seen = np.zeros((len(codes) + 1, symbols + 1), dtype=np.int32)
        seen[np.arange(1, len(codes) + 1), before + 1] = 1
        #: less[i, c]: symbols below c in front of the first i suffixes.
        self.less = np.cumsum(np.cumsum(seen, axis=0, dtype=np.int32), axis=1, dtype=np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=symbols))]).astype(np.int64)

    def grow(self, here, other, size, symbol):
        """The interval, the one in the reverse, and the size after one more symbol in front."""
        low, high = self.less[here, symbol], self.less[here + size, symbol]
        inside, upto = self.less[here, symbol + 1] - low, self.less[here + size, symbol + 1] - high
        return self.first[symbol] + inside, other + (high - low), upto - inside

    def grow_all(self, here, other, size):
        """By each letter there is: which interval grew, its letter, and the grown interval."""
        low, high = self.less[here], self.less[here + size]
        sizes = np.diff(high - low, axis=1)
        sizes[:, :DELIMITER + 1] = 0
        k, c = np.nonzero(sizes)
        return k, c, (self.first[c] + low[k, c + 1] - low[k, c], other[k] + high[k, c] - low[k, c], sizes[k, c])


class Index:
    """A bidirectional FM-index over words between delimiters."""

    def __init__(self, words: list[str], letters: list[str]):
        self.words, self.code = words, {c: k + 2 for k, c in enumerate(letters)}
        text = [DELIMITER]
        for word in words:
            text += [*map(self.code.__getitem__, word), DELIMITER]
        self.text = np.array([*text, END], dtype=np.int64)
        self.starts = np.cumsum([0, *(len(w) + 1 for w in words)])
        symbols = len(letters) + 2
        self.ahead = Half(self.text, symbols)  # grows to the left
        self.back = Half(np.array([*text[::-1], END], dtype=np.int64), symbols)  # grows to the right

    def near(self, queries: list[str], left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) one edit apart that agree in the query's left (or right) half.

        On the right side, pairs that agree in the left half as well are left out.
        """
        found, by_length = [], {}
        for k, word in enumerate(queries):
            by_length.setdefault(len(word), []).append(k)
        for length, members in by_length.items():
            codes = np.array([[self.code[c] for c in queries[k]] for k in members], dtype=np.int64)
            at, cut = np.array(members), length // 2
            q, low = self._search(codes, cut, left)
            word = np.searchsorted(self.starts, self.ahead.order[low])
            if not left:
                same = (self.text[self.starts[word][:, None] + 1 + np.arange(cut)] == codes[q, :cut]).all(axis=1)
                q, word = q[~same], word[~same]
            found.append((at[q], word))
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def _search(self, codes: np.ndarray, cut: int, left: bool) -> tuple[np.ndarray, np.ndarray]:
        """Query numbers and the suffix rank of each delimited word found."""
        count = len(codes)
        edge = np.full(count, DELIMITER)
        # The exact half grows from the cut to its delimiter, then the other one away from the cut.
        if left:
            exact, rest = [codes[:, k] for k in range(cut - 1, -1, -1)], [codes[:, k] for k in range(cut, codes.shape[1])]
            inner, outer = self.ahead, self.back
        else:
            exact, rest = [codes[:, k] for k in range(cut, codes.shape[1])], [codes[:, k] for k in range(cut - 1, -1, -1)]
            inner, outer = self.back, self.ahead
        q = np.arange(count)
        zero = np.zeros(count, dtype=np.int64)
        state = (zero, zero, np.full(count, len(self.text), dtype=np.int64))
        for symbol in [*exact, edge]:
            state, q = _kept(inner.grow(*state, symbol[q]), q)
        none = np.zeros(0, dtype=np.int64)
        one, one_q = (none, none, none), none  # searches that have had their error
        clean, clean_q = (state[1], state[0], state[2]), q  # seen from the other half now
        for k in range(len(rest) + 1):
            last = k == len(rest)
            of, c, grown = outer.grow_all(*clean)
            wanted = edge[clean_q[of]] if last else rest[k][clean_q[of]]
            other = c != wanted  # an added letter equal to the next one is found behind it
            added, added_q = tuple(x[other] for x in grown), clean_q[of[other]]
            one, one_q = _both(one, added), np.concatenate([one_q, added_q])
            one, one_q = _kept(outer.grow(*one, (edge if last else rest[k])[one_q]), one_q)
            if last:
                break
            # Replaced letters, and left out ones: of equal letters in a row the last.
            one, one_q = _both(one, added), np.concatenate([one_q, added_q])
            out = np.ones(len(clean_q), dtype=bool) if k + 1 == len(rest) else rest[k][clean_q] != rest[k + 1][clean_q]
            one, one_q = _both(one, tuple(x[out] for x in clean)), np.concatenate([one_q, clean_q[out]])
            clean, clean_q = _kept(outer.grow(*clean, rest[k][clean_q]), clean_q)
        return one_q, one[1] if left else one[0]


def _kept(state, q):
    some = state[2] > 0
    return tuple(x[some] for x in state), q[some]


def _both(a, b):
    return tuple(np.concatenate([x, y]) for x, y in zip(a, b))


def _halves(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index and search rows ``side, half, word, n``."""
    n = F.length("word")
    cut = F.floor(n / 2).cast("int")

    def side(left: int, *lengths) -> DataFrame:
        taken = F.array_distinct(F.array(*lengths))
        rows = words.select("word", "n", F.explode(taken).alias("long"))
        half = F.substring("word", F.lit(1), F.col("long")) if left else F.substring(
            F.col("word"), F.length("word") - F.col("long") + 1, F.col("long"))
        return rows.select(F.lit(left).alias("side"), half.alias("half"), "word", "n")

    # A word as long as this one, one shorter and one longer ask for these lengths.
    lefts = [F.floor((n + d) / 2).cast("int") for d in (-1, 0, 1)]
    rights = [(n + d - F.floor((n + d) / 2)).cast("int") for d in (-1, 0, 1)]
    return side(1, *lefts).unionAll(side(0, *rights)), side(1, cut).unionAll(side(0, (n - cut).cast("int")))


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """``word, n_near, best_n, best``: how many words are one edit away, and the most frequent of them.

    ``words`` holds each word once, with its count ``n``; equal counts go to the least word.
    """
    entries, searches = _halves(words)
    sizes = materialize(entries.groupBy("side", "half").count())
    total = sizes.agg(F.sum("count")).first()[0] or 0
    crowded = sizes.where(F.col("count") > shard).select(
        "side", "half", F.ceil(F.col("count") / shard).cast("int").alias("many"))
    if crowded.count() <= MOST_BROADCAST:
        crowded = F.broadcast(crowded)
    shards = max(1, math.ceil(total / shard))
    part = F.pmod(F.crc32(F.col("word").cast("binary")), F.col("many")).cast("int")

    def dealt(rows: DataFrame, parts, search: bool) -> DataFrame:
        many = F.coalesce("many", F.lit(1))
        out = rows.join(crowded, ["side", "half"], "left").withColumn("many", many).withColumn("part", parts)
        return out.select("side", F.pmod(F.xxhash64("half", "part"), F.lit(shards)).alias("shard"),
                          F.lit(search).alias("search"), "word", "n", "part", "many")

    rows = dealt(entries, part, False).unionAll(
        dealt(searches, F.explode(F.sequence(F.lit(0), F.col("many") - 1)), True))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        asked = frame[frame["search"]]
        held = frame[~frame["search"]].drop_duplicates("word").sort_values("word")
        words, counts = held["word"].tolist(), held["n"].to_numpy()
        queries, left = asked["word"].tolist(), bool(frame["side"].iloc[0])
        index = Index(words, sorted(set("".join(words)) | set("".join(queries))))
        q, w = index.near(queries, left)
        many, part = asked["many"].to_numpy(), asked["part"].to_numpy()
        if (many > 1).any():  # words dealt to this shard for another half do not count here
            own = np.array([zlib.crc32(x.encode()) for x in words], dtype=np.int64)
            mine = own[w] % many[q] == part[q]
            q, w = q[mine], w[mine]
        order = np.lexsort((w, -counts[w], q))
        q, w = q[order], w[order]
        first = np.diff(q, prepend=-1) != 0
        near = np.bincount(q, minlength=len(queries))[q[first]]
        return pd.DataFrame({"word": pd.Series([queries[k] for k in q[first]], dtype=object), "n_near": near,
                             "best_n": counts[w[first]], "best": pd.Series([words[k] for k in w[first]], dtype=object)})

    found = rows.groupBy("side", "shard").applyInPandas(run, "word string, n_near bigint, best_n bigint, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("x")).select(
        "word", "n_near", (-F.col("x.n")).alias("best_n"), F.col("x.word").alias("best"))


def with_roots(forms: DataFrame) -> DataFrame:
    """``word, form, root`` for rows ``word, form, form_n``, by jumping to the form's form.

    Counts grow by ``FACTOR`` at each step, so a few doublings reach the end of every chain.
    """
    found = materialize(forms.select("word", "form", F.col("form").alias("root")))
    most = forms.agg(F.max("form_n")).first()[0] or 0
    steps = max(1, math.ceil(math.log(max(most, 2), FACTOR)) + 1)
    for _ in range(math.ceil(math.log2(steps)) if steps > 1 else 0):
        ahead = found.select(F.col("word").alias("at"), F.col("root").alias("next"))
        found = materialize(found.join(ahead, F.col("root") == F.col("at"), "left").select(
            "word", "form", F.coalesce("next", "root").alias("root")))
    return found


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least_chars: int = LEAST_CHARS,
                   least_count: int = LEAST_COUNT, factor: int = FACTOR, one_in: int = DELETE_ONE_IN,
                   shard: int = SHARD) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word that is frequent enough.

    A word's form is its most frequent near word, if that is ``factor`` times as frequent.
    """
    if factor < FACTOR:
        raise ValueError(f"chains are followed for factors from {FACTOR} on")
    words = materialize(word_counts(docs, id_col, text, least_chars, one_in).where(F.col("n") >= least_count))
    near = near_words(words, shard)
    known = materialize(words.join(near, "word", "left"))
    follows = F.col("best_n") >= factor * F.col("n")
    roots = with_roots(known.where(follows).select("word", F.col("best").alias("form"), F.col("best_n").alias("form_n")))
    return known.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(follows, F.col("best_n")).alias("form_n"))

"""Spelling variants against all edits of each word."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from temblor.llm import queries, spelling

LETTERS = "[A-Za-zÀ-ÿ]+"


def edits(word, letters):
    found = {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in letters}
    found |= {word[:k] + c + word[k + 1:] for k in range(len(word)) for c in ["", *letters]}
    return found - {word}


def brute(rows, one_in=199):
    counts = Counter()
    for key, text in rows:
        for run in re.findall(LETTERS, text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % one_in == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    letters = sorted(set("".join(words)))
    near = {w: sorted((-words[x], x) for x in edits(w, letters) & words.keys()) for w in words}
    form = {w: x[0][1] if x and -x[0][0] >= 5 * words[w] else None for w, x in near.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else -1) for w, n in words.items())


def rows_of(frame):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or -1) for r in frame.collect())


def made_texts(seed, letters, count, long=(6, 10)):
    random.seed(seed)
    base = ["".join(random.choice(letters) for _ in range(random.randint(*long))) for _ in range(count)]
    words = base + [random.choice(sorted(edits(random.choice(base), letters))) for _ in range(3 * count)]
    return [" ".join(random.choice(words[:random.randint(1, len(words))]) for _ in range(150)) for _ in range(60)]


@pytest.mark.parametrize("letters", ["ab", "abcé"])
def test_index_finds_each_pair_once(letters):
    random.seed(7)
    for _ in range(25):
        words = sorted({"".join(random.choice(letters) for _ in range(random.randint(4, 9))) for _ in range(150)})
        index = spelling.Index(words, sorted(letters))
        found = []
        for left in (True, False):
            q, w = index.near(words, left)
            found += zip(q.tolist(), w.tolist())
        assert len(found) == len(set(found))
        assert set(found) == {(k, words.index(x)) for k, u in enumerate(words) for x in edits(u, letters) & set(words)}


def test_suffix_ranks():
    random.seed(8)
    for _ in range(100):
        codes = [random.choice([1, 2, 3]) for _ in range(random.randint(0, 60))] + [0]
        got = spelling.suffix_ranks(spelling.np.array(codes), random.choice([2, 5, 31])).tolist()
        assert got == sorted(range(len(codes)), key=lambda k: codes[k:])


@pytest.mark.parametrize("shard", [8000, 60, 7])
def test_forms_by_shards_of_any_size(spark, docs, shard):
    texts = made_texts(11, "abcé", 40)
    got = rows_of(spelling.spelling_forms(docs(texts), shard=shard))
    assert got == brute(list(enumerate(texts))) and any(r[1] for r in got)


def test_words_that_share_one_half(spark, docs):
    random.seed(12)
    words = ["hotten" + "".join(random.choice("ab") for _ in range(random.randint(5, 6))) for _ in range(80)]
    texts = [" ".join(random.choice(words) for _ in range(40)) for _ in range(60)]
    assert rows_of(spelling.spelling_forms(docs(texts), shard=5)) == brute(list(enumerate(texts)))


def test_chains_end_at_the_root(spark, docs):
    chain = ["abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk", "abcdefghijkl"]
    texts = [" ".join([w] * 5 ** (k + 1)) for k, w in enumerate(chain)]
    got = rows_of(spelling.spelling_forms(docs(texts)))
    assert got == brute(list(enumerate(texts))) and {r[2] for r in got} == {"abcdefghijkl"}


def test_odd_texts(spark, docs, tables):
    texts = [None, "", "short words", "Ärger ärger ÄRGERLICH " * 3, "ÄRGERLICH Ärgerlich ÄrgerlicH " * 4, "x" * 300 + " " + "x" * 299,
             "Repeated repeated repeate×d repeated " * 2, "aaaaaaa aaaaaa " * 30]
    rows = [*enumerate(texts * 6), (3, texts[3]), (None, "nameless " * 6)]
    frame = docs(rows).withColumn("n", F.lit("clash")).withColumn("word", F.lit("clash"))
    want = brute(rows)
    assert rows_of(spelling.spelling_forms(frame)) == want
    assert rows_of(queries.op12_spelling(spark, tables(documents=frame))) == want
    assert spelling.spelling_forms(docs([])).count() == 0
    assert spelling.spelling_forms(docs([None, "a b"])).count() == 0


def test_code_points_go_by_their_hash(spark, docs):
    texts = made_texts(13, "abcd", 5)
    assert rows_of(spelling.spelling_forms(docs(texts), one_in=3)) == brute(list(enumerate(texts)), 3)

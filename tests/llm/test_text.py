"""SimHash, quality rules, BPE and line templates against brute force."""

import math
import random
import re

import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from temblor.llm import bpe, components, line_templates, quality_rules, queries, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LETTERS = str.maketrans("0123456789", "ghijklmnop")
LONG = "word " * 30_000 + "end"
ODD = [None, "", " \t\n ", "one", "Two words", LONG, "same text again and again", "same text again and again",
       "Größe ÄÖ é", "a\x0bb\x0cc\x1cd"]


def brute_fingerprint(text, n):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            ones[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * ones[k] > len(shingles))


def test_simhash_of_odd_texts(spark, docs):
    frame = docs(ODD).union(docs([(3, "one")])).union(docs([(None, "one")])).selectExpr("*", "1 as fp", "2 as root")
    got = sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in simhash.fingerprint_groups(frame).collect())
    want = []
    for k, t in [*enumerate(ODD), (3, "one"), (-1, "one")]:
        f = brute_fingerprint(t, 3)
        same = [i for i, x in enumerate(ODD) if (brute_fingerprint(x, 3) ^ f).bit_count() <= 2]
        want.append((k, f"{f:016x}", min(same)))
    assert got == sorted(want)


def test_simhash_of_no_documents(spark, docs):
    assert simhash.fingerprint_groups(docs([])).count() == 0
    assert simhash.near_duplicates(docs([])).count() == 0


@pytest.mark.parametrize("crowded", [2048, 20])
def test_links_join_all_near_fingerprints(spark, monkeypatch, crowded):
    monkeypatch.setattr(simhash, "CROWDED", crowded)
    random.seed(3)
    values = {0, 1, (1 << 63)}
    for _ in range(40):
        base = random.getrandbits(64)
        for _ in range(10):
            x = base
            for _ in range(random.randint(0, 4)):
                x ^= 1 << random.randrange(64)
            values.add(x)
    base = random.getrandbits(64)  # a crowd that differs in few places
    values |= {base ^ (1 << i) ^ (1 << j) for i in range(0, 24) for j in range(i)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    frame = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    links = simhash.fingerprint_links(frame, 2)
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) & (2 ** 64 - 1)).bit_count() <= 2
    root = {r["node"]: r["root"] for r in components.components(links).collect()}
    above = list(range(len(values)))

    def top(k):
        while above[k] != k:
            k = above[k]
        return k

    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= 2:
                above[top(i)] = top(j)
    groups = {}
    for i, v in enumerate(signed):
        groups.setdefault(top(i), set()).add(root.get(v, v))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set.union(*groups.values())) == len(groups)


def test_components_of_long_chains(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(300)] + [("x", "x"), ("y", None), ("p", "q"), ("q", "p"), ("p", "q")]
    found = components.components(spark.createDataFrame(chain, "a string, b string")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len({roots[f"n{k}"] for k in range(301)}) == 1
    assert roots["p"] == roots["q"] != roots["n0"] and "x" not in roots and "y" not in roots


def test_near_duplicates_keep_one_of_each(spark, docs):
    random.seed(5)
    base = [f"w{random.randrange(5000)}" for _ in range(400)]
    near = list(base)
    near[100], near[300] = "other", "words"
    half = base[:200] + [f"v{k}" for k in range(200)]
    far = [f"u{random.randrange(5000)}" for _ in range(400)]
    texts = [" ".join(x) for x in (base, near, base, half, far)] + [None, "", "  "]
    frame = docs(texts).union(docs([(4, texts[4])])).selectExpr("*", "'x' as group_id", "5 as slot")
    found = simhash.near_duplicates(frame)
    got = {r["doc_id"]: (r["group_id"], r["keeper"]) for r in found.collect()}
    assert got == {0: (0, True), 1: (0, False), 2: (0, False), 3: (3, True), 4: (4, True), 5: (5, True),
                   6: (5, False), 7: (5, False)}
    assert found.count() == 8 and found.columns == [*docs([]).columns, "slot", "group_id", "keeper"]


def test_near_duplicates_find_every_pair_at_the_similarity(spark, docs):
    random.seed(11)
    texts = []
    for k in range(1000):
        both = [f"b{random.randrange(10 ** 9)}" for _ in range(84)]  # 80 shingles in common, 10 of each one's own
        texts += [" ".join([*both, *(f"{side}{random.randrange(10 ** 9)}" for _ in range(10))]) for side in "xy"]
    for k in range(0, 2000, 2):
        shard = simhash.Shard(20, 0.8)
        assert list(shard.add("a", 0, texts[k], 5)) == [] and list(shard.add("b", -1, texts[k + 1], 5)) == [("b", "a")]
    got = simhash.near_duplicates(docs(texts)).collect()
    assert {r["doc_id"] for r in got if r["keeper"]} == set(range(0, 2000, 2))


def brute_base(text):
    words = WORD.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {k for at in windows.values() if len(at) > 1 for i in at for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)),
            len(covered), failed)


def brute_scores(texts, trusted, buckets):
    grams = [[xxhash.xxh64_intdigest(w.encode(), 42) & (buckets - 1) for w in WORD.findall(t or "")] for t in texts]
    raw, target = [0] * buckets, [0] * buckets
    for k, g in enumerate(grams):
        for b in g:
            raw[b] += 1
            target[b] += k in trusted
    if not sum(target):
        return [0.0] * len(texts)
    ratio = [math.log((t + 1) / (sum(target) + buckets)) - math.log((r + 1) / (sum(raw) + buckets))
             for t, r in zip(target, raw)]
    return [sum(ratio[b] for b in g) / len(g) if g else 0.0 for g in grams]


def rule_texts():
    random.seed(9)
    clean = [" ".join(random.choice("the of and water stone river hill tree".split()) + str(random.randrange(40))
                      for _ in range(60)) for _ in range(20)]
    junk = [" ".join(random.choice("buy now win".split()) + "$$$" + str(random.randrange(9)) for _ in range(60))
            for _ in range(6)]
    again = " ".join(["a b c d e f g h i j k l"] * 5) + "\nline\nline\n \nline"
    return [*clean, *junk, again, *[t if t is None or len(t) < 999 else "word " * 300 for t in ODD]]


def test_quality_rules(spark, docs):
    texts = rule_texts()
    frame = docs(texts).selectExpr("*", "'mine' as score", "1 as words")
    trusted = spark.createDataFrame([(k,) for k in range(12)] + [(None,), (3,)], "doc_id bigint")
    found = quality_rules.quality_rules(frame, trusted, buckets=1 << 10)
    scores = brute_scores(texts, set(range(12)), 1 << 10)
    for r in found.collect():
        base = brute_base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"],
                r["base_failed"]) == base
        assert abs(r["score"] - scores[r["doc_id"]]) < 1e-9
        assert r["kept"] == (not base[-1] and r["score"] >= -0.2)
    kept = {r["doc_id"] for r in found.where("kept").collect()}
    assert kept >= set(range(20)) and not kept & set(range(20, 26))


def test_quality_rules_without_trusted_or_documents(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint")
    found = quality_rules.quality_rules(docs(["x " * 8 + " ".join(map(str, range(40))), LONG]), none).collect()
    assert [r["kept"] for r in found] == [True, False] and {r["score"] for r in found} == {0.0}
    assert quality_rules.quality_rules(docs([]), none).count() == 0


def test_higher_orders_of_ngrams(spark, docs):
    frame = docs(["a b c d", "a b", "a", "", None])
    grams = quality_rules.hashed_ngrams(quality_rules.words_of(F.col("text")), (1, 2, 3), 1 << 16)
    found = {r["doc_id"]: r["g"] for r in frame.select("doc_id", grams.alias("g")).collect()}
    assert [len(found[k]) for k in range(5)] == [4 + 3 + 2, 2 + 1, 1, 0, 0]
    assert found[1] == [*found[0][:2], found[0][4]]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def automaton():
    return bpe.Automaton.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_automaton_equals_library(automaton, library):
    random.seed(4)
    texts = [t or "" for t in ODD] + ["a<|endoftext|>b  c", "x" * 500, "0123456789" * 30, "=-" * 90, "it's We'LL do"]
    texts += ["".join(chr(random.choice([random.randint(32, 126), random.randint(0xA0, 0x2FFF),
                                         random.randint(0x3000, 0xD7FF), random.randint(0xE000, 0x1FFFF)]))
                      for _ in range(40)) for _ in range(300)]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        ids = automaton.encode(text)
        assert ids == want.ids
        assert automaton.decode(ids) == text == library.decode(ids, skip_special_tokens=False)


def test_words_are_read_from_their_end(automaton):
    """Few parts of a word are looked up; plain texts split as the pattern says."""
    import copy

    import regex

    looked = []

    class Seen(dict):
        def get(self, key, other=None):
            looked.append(key)
            return super().get(key, other)

    seen = copy.copy(automaton)
    seen.ids, seen.arcs_of = Seen(automaton.ids), Seen(getattr(automaton, "arcs_of", {}))
    words = (b" leoureellean", b" aichenthouwhat", b" diechaukeitzu", b" queesasque")
    for word in words:
        assert b"".join(automaton.labels[k] for k in seen.word(word)) == word
    assert len(looked) < 0.6 * sum(len(w) * (len(w) + 1) // 2 for w in words)
    assert automaton.word(b"") == () and len(automaton.word(b"ab" * 30_000)) > 1
    random.seed(5)
    pattern = regex.compile(bpe.PATTERN)
    for _ in range(3000):
        text = "".join(random.choice("ab'sdtmlve 019\t\n\x0b\x1c\x1f.,-_\x00\x7f") for _ in range(30))
        assert bpe.ASCII_PATTERN.findall(text) == pattern.findall(text)


def test_every_pair_of_tokens_obeys_the_merges():
    base, merges = [0, 1], [(0, 0, 2), (0, 1, 3), (2, 1, 4), (3, 3, 5), (1, 3, 6), (2, 2, 7)]
    labels = {0: "a", 1: "b", 2: "aa", 3: "ab", 4: "aab", 5: "abab", 6: "bab", 7: "aaaa"}
    arcs, leads = bpe.compile_merges(base, merges, 8)
    machine = bpe.Automaton(arcs, leads, [labels[k].encode() for k in range(8)], {})

    def merged(text):
        out = [0 if c == "a" else 1 for c in text]
        for u, v, w in merges:
            k, new = 0, []
            while k < len(out):
                if out[k:k + 2] == [u, v]:
                    new.append(w)
                    k += 2
                else:
                    new.append(out[k])
                    k += 1
            out = new
        return tuple(out)

    for n in range(1, 11):
        for bits in range(1 << n):
            text = "".join("ab"[bits >> k & 1] for k in range(n))
            assert machine.word(text.encode()) == merged(text), text
    with pytest.raises(ValueError):
        bpe.compile_merges([0, 1], [(0, 1, 2), (1, 0, 2)], 3)


def test_encode_and_decode_columns(spark, docs, library):
    path = public_tokenizers.path("byte_bpe_50k.json")
    frame = docs(ODD).withColumnRenamed("lang", "ids")
    coded = bpe.encode(frame, path)
    back = bpe.decode(coded, path, out="back")
    for r in back.collect():
        assert r["ids"] == library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["back"] == (r["text"] or "")
    assert bpe.encode(docs([]), path).count() == 0 and bpe.round_trip(docs([]), path).count() == 0


def test_round_trip_query(spark, docs, tables, library):
    import hashlib

    folder = tables(documents=docs(ODD))
    for r in queries.op10_bpe(spark, folder).collect():
        text = ODD[r["doc_id"]] or ""
        ids = library.encode(text, add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_least_pairs_are_sorted_as_numbers(spark):
    random.seed(8)
    texts = [" ".join(str(random.randrange(50)) for _ in range(n)) for n in (0, 1, 2, 20, 200)] + [""]
    frame = spark.createDataFrame([(t,) for t in texts], "text string").selectExpr("split(text, '[ \\n]') as w")
    found = frame.select("w", line_templates.least_pairs(F.col("w")).alias("least"), F.expr(
        "transform(w, (x, i) -> xxhash64(x, get(w, i + 1)))").alias("pairs"))
    assert "array_sort" not in found._jdf.queryExecution().executedPlan().toString()
    for r in found.collect():
        assert r["least"] == sorted(set(r["pairs"]))[:line_templates.MARKS]


def test_recurring_templates_go(spark, docs):
    random.seed(6)
    texts = []
    for k in range(30):
        own = [" ".join(f"w{random.randrange(10 ** 6):x}q" for _ in range(9)) for _ in range(4)]
        own.insert(2, f"Copyright 20{k:02d} by the house of pages number {k}")
        own.append("All rights reserved.")
        texts.append("\n".join(own))
    copies = ["\n".join(["first own line of copies stays here", "second own line of copies stays too", "ok"])] * 40
    frame = docs([*texts, *copies, None, "", "Copyright 1999 by the house of pages number 7"]).selectExpr(
        "*", "1 as leaf", "2 as place", "3 as hash", "4 as id")
    found = {r["doc_id"]: r for r in line_templates.drop_recurring_lines(frame).collect()}
    assert len(found) == 73
    for k, text in enumerate(texts):
        lines = text.split("\n")
        assert found[k]["text"].split("\n") == lines[:2] + lines[3:5]
        assert found[k]["n_chars"] == len(found[k]["text"])
    assert all(found[30 + k]["text"] == copies[0] for k in range(40))
    assert found[70]["text"] is None and found[71]["text"] == "" and found[72]["text"] == ""
    assert line_templates.drop_recurring_lines(docs([])).count() == 0


def test_passages_go_whatever_their_hashes_and_near_copies_stay(spark, docs):
    random.seed(8)

    def words(n):
        return " ".join(f"w{random.choice('abcdefgh')}{random.randrange(10 ** 6):x}q".translate(LETTERS) for _ in range(n))

    texts, want = [], []
    for _ in range(12):  # a passage as long as what else the texts say, so that its least hash is that of many
        passage = words(60)
        for k in range(12):
            lines = [words(20) for _ in range(3)]
            texts.append("\n".join([*lines[:1], passage, *lines[1:]]))
            want.append("\n".join(lines))
    article = [words(10) for _ in range(20)]
    for k in range(60):  # near copies: a line of each is another one
        copy = list(article)
        copy[k % 20] = words(9)
        texts.append("\n".join(copy))
        want.append(texts[-1])
    found = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(texts)).collect()}
    assert [found[k] for k in range(len(texts))] == want


def test_lines_are_masked_once_and_leaves_counted_from_leading_tokens(spark):
    lines = ["all of these are plain words", "page  7 of\t12 pages here", "\x0b a1 b2 c3 words \r", "1 2 3 4 word", "",
             "two words", " \t ", "caf\u00e9 x9y \u4e2d\u6587 d\u00e9j\u00e0 vu 2nd", "a\x0cb\x0bc d", "three\u00a0is no blank here"]
    base = spark.createDataFrame([("1", 5, "\n".join(lines)), ("2", 6, "")], "id string, hash bigint, body string")

    def tokens(line):
        return ["<*>" if re.search("[0-9]", t) else t for t in re.split("[ \t-\r]+", line.strip(" \t\n\x0b\x0c\r")) if t]

    want, every = [], []
    for k, line in enumerate(lines):
        t = tokens(line)
        every.append((len(t), " ".join(t[:3])))
        if len(t) >= 3 and 2 * t.count("<*>") <= len(t):
            want.append((k, every[-1], " ".join(t)))
    keys = {(r["n"], r["head"]): r["leaf"] for r in spark.createDataFrame(every, "n int, head string").selectExpr(
        "n", "head", "xxhash64(n, head) as leaf").collect()}
    found = line_templates.masked_lines(base, 3, 3)
    counted = line_templates.leaves(base.where("id = '1'"), 3)
    assert sorted(tuple(r) for r in found.collect()) == [("1", 5, k, keys[x], t) for k, x, t in want]
    assert sorted(r["leaf"] for r in counted.collect()) == sorted(keys[x] for x in every)
    for frame in (found, counted):  # functions of array elements are interpreted, expressions of columns compiled
        assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()
    assert found._jdf.queryExecution().optimizedPlan().toString().count("x09-") == 2  # one mask: its test, its spaces


def test_templates_widen_but_keep_apart():
    leaf = line_templates.Leaf(2, 0.75)
    a = leaf.place("the price of tea is now ten coins")
    assert leaf.place("the price of tea is now six coins") == a
    assert leaf.place("the price was never known to be low") != a
    assert leaf.templates[a].count(line_templates.VARIABLE) == 1

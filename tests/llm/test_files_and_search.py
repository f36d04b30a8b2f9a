"""Record files, archives, page templates, mixing, inner products, the line field and the pipeline."""

import base64
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from temblor.llm import (
    html_templates, inner_product, line_crf, mixing, outputs, queries, records, warc,
)

LONG = "Long words here " * 20_000
PATH = public_tokenizers.path("word_bpe_49k.json")


def test_encoder_equals_library():
    random.seed(2)
    encode, library = records.Encoder(PATH), Tokenizer.from_file(PATH)
    texts = ["", "It's DON'T 'S", "ª º µ ² ½ \xad – “x” … €5", "<|endoftext|> A", "Ελληνικά Σ", "é İstanbul", LONG]
    texts += ["".join(chr(random.choice([random.randint(32, 126), random.randint(0xA1, 0x17F), 10, 9, 39,
                                         random.randint(0x2010, 0x2027)])) for _ in range(60)) for _ in range(300)]
    got = [np.frombuffer(x, dtype=encode.dtype).tolist() for x in encode.encode(texts)]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


def test_records_round_trip(spark, docs):
    texts = ["b c", None, "", LONG, "Ünï çödé", "b c"]
    frame = docs(texts).union(docs([(3, "x"), (None, "y")])).selectExpr("*", "1 as id", "2 as key")
    folder = outputs.new_folder(spark, "test")
    manifest = records.write_records(frame, folder, PATH, file_bytes=100)
    assert manifest.agg(F.sum("records")).first()[0] == 8 and manifest.count() > 1
    library, start = Tokenizer.from_file(PATH), 0
    got = records.read_records(spark, folder).orderBy("start").collect()
    rows = sorted([*enumerate(texts), (3, "x"), (-1, "y")], key=lambda r: (r[0], r[1] or ""))
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"]) == (doc, start, len(ids))
        assert bytes(r["ids"]) == np.array(ids, dtype="<u4").tobytes()
        start += len(ids)
    index = records.read_index(spark, folder)
    again = records.read_at(index.orderBy(F.desc("offset"), "file"), folder)
    plain = sorted((r["n_tokens"], bytes(r["ids"])) for r in got)
    assert sorted((r["n_tokens"], bytes(r["ids"])) for r in again.collect()) == plain


def test_broken_records_are_found(tmp_path):
    import io

    good = records.frame(7, 2, b"\x01\x00\x02\x00")
    assert [(d, t.tolist()) for d, t in records._payloads(io.BytesIO(good * 2))] == [(7, [1, 2])] * 2
    for k in (3, 9, len(good) - 6):
        bad = bytearray(good)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            list(records._payloads(io.BytesIO(bytes(bad))))


def test_records_of_no_documents(spark, docs):
    folder = outputs.new_folder(spark, "test")
    records.write_records(docs([]), folder, PATH)
    assert records.read_records(spark, folder).count() == 0 and records.read_index(spark, folder).count() == 0


PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize("least", [0, 4])
def test_warc_round_trip(spark, least):
    rows = [(1, "http://a/", "same"), (5, "http://b/\r\nX: y", "same"), (3, None, None), (4, "u", ""), (2, "u", LONG),
            (9, "u", "é\r\n\r\nx"), (5, "http://b/", "same"), (7, "u", "abc"), (8, "u", "abc")]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as digest", "2 as kind")
    folder = outputs.new_folder(spark, "test")
    warc.write_warc(frame, folder, least_bytes=least, file_bytes=600)
    got = warc.read_warc(spark, folder).collect()
    assert len(got) == len(rows)
    largest = defaultdict(int)
    for page, _, body in rows:
        largest[body or ""] = max(largest[body or ""], page)
    kinds = defaultdict(list)
    for r in got:
        kinds[r["page_id"]].append(r)
    for page, url, body in rows:
        data = (body or "").encode()
        for r in kinds[page]:
            assert r["payload_bytes"] == len(data)
            assert r["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
            if r["record_type"] == "response":
                assert bytes(r["payload"]) == data and r["refers_to"] is None
            else:
                assert r["refers_to"] == largest[body or ""] and len(data) >= least
        if largest[body or ""] != page and len(data) >= least:
            assert [r["record_type"] for r in kinds[page]] == ["revisit"]
        else:
            assert [r["record_type"] for r in kinds[page]].count("response") == 1 or len(data) < least
    assert sorted(r["record_type"] for r in kinds[5]) == ["response", "revisit"]
    assert [r["url"] for r in kinds[3]] == [None]


def test_warc_files_are_the_same_again(spark):
    from pyarrow import fs

    rows = [(k, f"http://h/{k}", f"page {k % 7} " * 50) for k in range(40)]
    found = []
    for n in (1, 2):
        folder = outputs.new_folder(spark, "test")
        manifest = warc.write_warc(spark.createDataFrame(rows[::n] + (rows[1::2] if n == 2 else []), PAGES), folder)
        store, root = outputs.opened(folder)
        assert isinstance(store, fs.FileSystem)
        found.append({r["file"]: hashlib.sha1(store.open_input_stream(f"{root}/{r['file']}", compression=None).read())
                      .hexdigest() for r in manifest.collect()})
    assert set(found[0].values()) == set(found[1].values())


def test_warc_of_no_pages(spark):
    folder = outputs.new_folder(spark, "test")
    warc.write_warc(spark.createDataFrame([], PAGES), folder)
    assert warc.read_warc(spark, folder).count() == 0


def page(k, body, extra="", host="h"):
    return (k, f"http://{host}/{k}", f"""<html><head><title>T{k}</title><style>p{{}}</style></head><body>
      <nav><a href="/{k}">Home {k}</a></nav><header>Site name</header><div class="cookie-notice">We use cookies</div>
      {body}<aside>More {k}</aside><div id=comments><p>Nice {k}</p></div>{extra}
      <form><p>Mail</p></form><footer>&copy; {k}</footer><script>var x = "<p>no</p>";</script></body></html>""")


def test_main_text_of_articles(spark):
    rows = [page(k, f"<article><h1>Title&nbsp; {k}</h1><p>One <b>bo</b>ld\n &amp; {k}<br>next<p>Two {k}"
                    f"<div>Share this</div></article>") for k in range(8)]
    rows += [(20, None, None), (21, "", ""), (22, "x", "plain < text &lt;&#233;"), (23, "u", "<p>" + LONG), rows[0]]
    frame = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 as host", "2 as template")
    found = html_templates.extract(frame)
    got = {r["page_id"]: r["text"] for r in found.collect()}
    assert found.count() == len(rows)
    for k in range(8):
        assert got[k] == f"Title {k}\nOne bold & {k} next\nTwo {k}"
    assert got[20] == got[21] == "" and got[22] == "plain < text <é" and got[23] == " ".join(LONG.split())
    assert all(r["n_chars"] == len(r["text"]) for r in found.collect())
    few = spark.createDataFrame(rows[:2], PAGES)
    assert {r["text"] for r in html_templates.extract(few).collect()} == {
        f"Title {k}\nOne bold & {k} next\nTwo {k}\nShare this" for k in range(2)}


def test_copies_of_a_page_are_no_template(spark):
    story = "<div class=content><div>Story one</div><div>Story two</div></div>"
    rows = [(k, f"http://h/{k // 2}", page(0, story)[2]) for k in range(12)]  # two rows of each of six urls
    rows += [page(k, f"<div class=content><div>Tale {k}</div><div>Read on</div><div>Go back</div></div>") for k in range(20, 25)]
    for most in (1_000_000, 0):
        got = {r["page_id"]: r["text"] for r in html_templates.extract(
            spark.createDataFrame(rows, PAGES), most_broadcast=most).collect()}
        assert got == {k: "Story one\nStory two" for k in range(12)} | {k: f"Tale {k}" for k in range(20, 25)}


def test_templates_without_article_tags(spark):
    rows = [page(k, f"<div class=content><p>Story {k} one</p><p>Story {k} two</p><div>Read on</div></div>")
            for k in range(6)]
    got = {r["page_id"]: r["text"] for r in html_templates.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {k: f"Story {k} one\nStory {k} two" for k in range(6)}
    many = html_templates.extract(spark.createDataFrame(rows, PAGES), most_broadcast=0)
    assert {r["page_id"]: r["text"] for r in many.collect()} == got
    assert html_templates.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_classes_keep_their_order_each_time_and_nest(spark):
    def texts(bodies):
        rows = [(k, f"http://h/{k}", "<html><body>" + "".join(f"<div>{x}</div>" for x in body) + "</body></html>")
                for k, body in enumerate(bodies)]
        found = html_templates.extract(spark.createDataFrame(rows, PAGES)).collect()
        return {r["page_id"]: r["text"].split("\n") for r in found}

    # Two texts that stand around others twice, the second time the other way round, are no class.
    mixed = texts([["One", "Two", f"Story {k}", *(["Two", "One"] if k % 2 else ["One", "Two"])] for k in range(8)])
    assert all(sorted(mixed[k]) == ["One", "One", f"Story {k}", "Two", "Two"] for k in mixed)
    even = texts([["One", "Two", f"Story {k}", "One", "Two"] for k in range(8)])
    assert all(even[k] == [f"Story {k}"] for k in even)
    # A class in one slot of another is template; in two slots it is none.
    same = texts([["Top", *(["Left", "Right"] if k > 1 else []), f"Story {k}", "Middle", "Low"] for k in range(8)])
    assert all(same[k] == [f"Story {k}"] for k in same)
    moved = texts([["Top", *(["Left", "Right"] if k in (2, 3, 4) else []), f"Story {k}", "Middle",
                    *(["Left", "Right"] if k > 4 else []), "Low"] for k in range(8)])
    assert all(sorted(moved[k]) == sorted([f"Story {k}", *(["Left", "Right"] if k > 1 else [])]) for k in moved)


def test_relations_of_classes():
    inner, outer = (7, 2, [2, 3, 4, 5]), (9, 3, [0, 1, 8])
    assert html_templates.relations([inner, outer]) == {(7, 9, 2): 2}
    assert html_templates.relations([(7, 2, [1, 3]), (9, 2, [0, 2])]) == {(7, 9, 1): 1, (7, 9, -1): 1}
    assert html_templates.relations([(7, 2, [0, 1]), (9, 2, [2, 3])]) == {}


def test_unclosed_menu_keeps_the_article():
    text = html_templates.main_text("<nav><a>x</a><article><p>Kept</article><footer>f", frozenset())
    assert text == "Kept"


def brute_share(budget, limits, weights):
    """Water-filling one saturated child after the other."""
    order = sorted(limits, key=lambda c: (weights[c] == 0, limits[c] / weights[c] if weights[c] else 0))
    given, left, rest = {}, budget, sum(weights.values())
    for c in order:
        if weights[c] and limits[c] * rest <= left * weights[c]:
            given[c], left, rest = limits[c], left - limits[c], rest - weights[c]
        else:
            break
    open_weight = sum(weights[c] for c in limits if c not in given)
    for c in order:
        if c not in given and weights[c]:
            given[c] = max(0, left * weights[c] // open_weight)
    for c in order:
        if c not in given:
            given[c] = max(0, min(limits[c], left)) if not open_weight else 0
            left -= given[c]
    return given


def brute_mix(rows, budget, weights, epochs, seed):
    tokens = defaultdict(int)
    for _, *leaf, n in rows:
        tokens[tuple(leaf)] += n

    def go(prefix, amount):
        depth = len(prefix)
        if depth == 3:
            return {prefix: amount}
        below = defaultdict(int)
        for leaf, n in tokens.items():
            if leaf[:depth] == prefix:
                below[leaf[depth]] += n
        level = ["domain", "lang", "source"][depth]
        w = {c: weights[level].get(c, 1) if level in weights else n for c, n in below.items()}
        given = brute_share(amount, {c: n * epochs for c, n in below.items()}, w)
        out = {}
        for c, a in given.items():
            out |= go((*prefix, c), a)
        return out

    plan, found = go((), min(budget, epochs * sum(tokens.values()))), []
    for leaf, amount in plan.items():
        own = [(k, n) for k, *x, n in rows if tuple(x) == leaf]
        whole = amount // tokens[leaf] if tokens[leaf] else 1
        found += [(k, *leaf, e) for e in range(whole) for k, _ in own]
        if whole < epochs:
            def place(k):
                return hashlib.md5(f"{k}:{seed}:{whole}".encode()).hexdigest()
            room = amount - whole * tokens[leaf]
            for h in sorted({place(k) for k, _ in own}):
                part = [(k, n) for k, n in own if place(k) == h]
                room -= sum(n for _, n in part)
                if room < 0:
                    break
                found += [(k, *leaf, whole) for k, _ in part]
    return sorted(found)


@pytest.mark.parametrize("share,weights", [(0.5, {"lang": {"en": 3, "de": 1}}), (1.0, {"lang": {"en": 1, "de": 9}}),
                                           (1.7, {"domain": {"x": 0}, "source": {"s1": 5}}), (9.0, {}), (0.0, {})])
def test_mixing_equals_brute_force(spark, share, weights):
    random.seed(8)
    rows = []
    for k in range(300):
        source = "s0" if random.random() < 0.4 else f"s{random.randrange(4)}"
        rows.append((k, random.choice("xyy"), random.choice(["en", "en", "de"]), source, random.randrange(0, 30)))
    rows += [(7, "x", "en", "s0", 5), (400, "z", "fr", "s9", 0)]
    frame = spark.createDataFrame([(k, d, a, s, "w " * n) for k, d, a, s, n in rows],
                                  "doc_id bigint, domain string, lang string, source string, text string")
    mixed = mixing.mix(frame, ["domain", "lang", "source"], F.floor(F.col("all") * share), weights, 3, 11)
    got = sorted((r["doc_id"], r["domain"], r["lang"], r["source"], r["epoch"]) for r in mixed.collect())
    assert got == brute_mix(rows, int(share * sum(r[-1] for r in rows)), weights, 3, 11)


def test_mixing_of_nulls_and_nothing(spark, docs):
    frame = docs([None, "a b", "c"]).withColumn("lang", F.lit(None).cast("string")).withColumn("epoch", F.lit("old"))
    mixed = mixing.mix(frame, ["lang", "source"], F.col("all"))
    assert sorted(r["doc_id"] for r in mixed.collect()) == [0, 1, 2] and mixed.columns == frame.columns
    assert mixing.mix(docs([]), ["lang", "source"], F.col("all")).count() == 0


def test_inner_products_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    m = np.round(rng.normal(size=(400, 12)) * rng.gamma(1.0, 1.0, size=(400, 1)), 2).astype(np.float32)
    m[50:80] = m[7]
    m[100:110] = 0
    rows = [(k, v.tolist()) for k, v in enumerate(m)]
    rows += [(500, None), (501, [None] * 12), (502, [float("nan")] * 12), (503, [float("inf")] * 12), (504, [1.0] * 3),
             (None, [1.0] * 12)]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").selectExpr("*", "1 as length", "2 as v")
    vectors = inner_product.whole_vectors(frame, "vec_id", "embedding")
    got = sorted(tuple(r) for r in inner_product.top_k(vectors, vectors.where("id % 50 = 0"), 5, head=4, block=64,
                                                       query_block=3, first=40).collect())
    whole = np.floor(256 * m.astype(np.float64)).astype(np.int64)
    want = []
    for q in range(0, 400, 50):
        s = whole @ whole[q]
        best = [k for k in np.lexsort((np.arange(400), -s)) if k != q][:5]
        want += [(q, r + 1, int(k), int(s[k])) for r, k in enumerate(best)]
    assert got == sorted(want)
    few = vectors.where("id < 3")
    assert inner_product.top_k(few, few.where("id = 0")).count() == 2
    assert inner_product.top_k(vectors.where("id < 0"), vectors.where("id < 0")).columns == [
        "query_id", "rank", "vec_id", "score"]


@pytest.mark.parametrize("scale", [1, 1 << 19])
def test_search_sorts_only_what_reaches_the_bar(scale):
    """Where bounds rule out little, scores below the k-th best are not kept; beyond 2^52 they are whole numbers."""
    rng = np.random.default_rng(3)
    ids, vectors = rng.permutation(4096).astype(np.int64), rng.integers(-256, 256, (4096, 64)) * scale
    added = []

    class Counted(inner_product.Search):
        def add(self, query, other, score):
            added.append(len(query))
            super().add(query, other, score)

    search = Counted(ids[:64], vectors[:64], np.eye(64), 5, 16)
    search.meet(ids, vectors)
    assert sum(added[1:]) < 64 * 3584 // 10
    for k in range(64):
        scores = (vectors @ vectors[k])
        want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[k])[:5]
        mine = search.query == k
        assert [(-s, i) for s, i in zip(search.score[mine].tolist(), search.other[mine].tolist())] == want


def test_forward_backward_equals_all_labellings():
    from itertools import product
    from math import exp

    emission, stay = [0.5, -2.0, 1.5, 0.1], (0.7, -0.3)
    total, good = 0.0, [0.0] * 4
    for y in product((0, 1), repeat=4):
        w = exp(sum(e for e, k in zip(emission, y) if k) + sum(stay[a] for a, b in zip(y, y[1:]) if a == b))
        total += w
        good = [g + w * k for g, k in zip(good, y)]
    assert np.allclose(line_crf.marginals(emission, stay), np.array(good) / total)


def test_line_field_learns(spark, docs):
    random.seed(12)
    texts, labels = [], []
    for k in range(120):
        bad = k % 3 == 0
        line = " ".join(random.choice("stone river hill tree water".split()) + str(random.randrange(9))
                        for _ in range(12))
        texts.append("\n".join((line.upper().replace(" ", "!! ") if bad else line + ".") for _ in range(4)))
        labels.append((k, 0 if bad else 1))
    frame = docs([*texts, None, "", LONG]).selectExpr("*", "'s' as score", "1 as h")
    known = spark.createDataFrame([*labels[:80], (None, 1), (5, None)], "doc_id bigint, quality int")
    scores = {r["doc_id"]: r["score"] for r in line_crf.quality(frame, known).collect()}
    assert len(scores) == 123 and all(0 <= s <= 1 for s in scores.values())
    assert all((scores[k] >= 0.3) == bool(y) for k, y in labels[80:])
    none = line_crf.quality(frame, known.where("doc_id < 0"))
    assert {r["score"] for r in none.collect()} == {0.5}
    assert line_crf.quality(docs([]), known).count() == 0


def test_held_out_accuracy(spark):
    from temblor.llm.queries import op7_line_crf

    folder = "/root/testdata/sf0.01"
    rows = op7_line_crf(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    right = rows.where("predicted = quality").count()
    assert right >= 0.95 * rows.count()
    assert rows.first()["held_out"] == (zlib.crc32(str(rows.first()["doc_id"]).encode()) % 5 == 0)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns(
        {c: F.lit(c) for c in ("score", "kept", "epoch", "domain", "row", "group_id")})
    first = docs
    kept = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(
            stage(spark, docs, folder).collect(), docs.schema)
        assert docs.columns == first.columns
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    assert kept[1] == kept[0] and kept[2] <= kept[1] and kept[3] <= kept[2] and kept[3]
    last = corpus_pipeline.STAGES[4][1](spark, docs, folder)
    assert last.count() == docs.count()


def test_pipeline_of_no_documents(spark, docs, tables):
    folder = tables(documents=docs([]), labels=spark.createDataFrame([], "doc_id bigint, quality int, toxic int"))
    assert corpus_pipeline.run(spark, folder).count() == 0


def test_every_operator_has_its_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))

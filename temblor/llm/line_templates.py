"""Line dedup by a tree of log templates.

Lines are parsed by a tree of fixed depth: token count first, then the leading
tokens, tokens with a digit standing for any. Below a leaf, lines that agree in
enough places share a template, in which the other places are variable. A
template that recurs across documents is boilerplate, and its lines go.

A document that was copied repeats all of its lines. What counts is therefore
how many kinds of documents have a template, told apart by what else they say:
of a document's ``MARKS`` least hashes of word pairs those are its own that under
half as many documents have as have the template. The least of these is its kind.
Documents with less than the share ``own`` of them are near copies of each other
and one kind together. A template recurs if it has enough kinds. Copies are left
to the near-duplicate stage, whole.

Only lines in leaves with enough lines are moved. Equal lines are counted before
they reach a tree; a crowded leaf is parsed in salted shares whose templates
are merged afterwards. Templates in a leaf are found by blocks of places, of
which similar lines have one in common, never by comparing all pairs.

Defined cases: a null text stays null, an empty one empty; lines of fewer than
``least_tokens`` tokens, and those more than half variable, always stay; a document all of whose lines go keeps its
row with an empty text; rows with equal id and text count once and lose the same lines; null ids
are allowed; an empty table gives an empty one; all columns of the input stay,
``n_chars`` is counted anew where there is one.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from temblor.llm.quality_rules import BLANKS, let
from temblor.session import materialize

VARIABLE = "<*>"
#: Shares a leaf is parsed in before its templates are merged.
SALTS = 16
#: Least hashes of word pairs that stand for a document.
MARKS = 32


def once(frame: DataFrame, name: str, value: Column) -> DataFrame:
    """``value`` as a column that later filters and columns read, whatever the optimizer moves; stays compiled."""
    return frame.withColumn(name, F.explode(F.array(value)))


def single_spaced(line: Column) -> Column:
    """A trimmed line with one space for each run of blanks; few lines have other ones."""
    odd = line.contains(F.lit("  "))
    for blank in BLANKS.replace(" ", "").replace("\n", ""):
        odd = odd | line.contains(F.lit(blank))
    return F.when(odd, F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")).otherwise(line)


def variables_in(line: Column) -> Column:
    """Tokens with a digit as variables, in tokens joined by spaces."""
    return F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", VARIABLE)


def masked(line: Column) -> Column:
    """Tokens of a trimmed line joined by spaces, those with a digit as variables."""
    spaced = F.regexp_replace(line, "[\\x20\\x09-\\x0D]+", " ")
    return F.when(line.contains(F.lit("  ")) | line.rlike("[0-9\\x09-\\x0D]"),
                  variables_in(spaced)).otherwise(line)  # most lines have neither


def n_tokens(line: Column) -> Column:
    """Tokens of a line joined by spaces, masked or not; without a branch, in which a line would be made anew."""
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return spaces + (line != "").cast("int")


def n_variables(line: Column) -> Column:
    """Variable tokens of a masked line."""
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit(VARIABLE), F.lit("")))) / len(VARIABLE)


def masked_lines(base: DataFrame, depth: int, least_tokens: int) -> DataFrame:
    """``id, hash, place, leaf, line``: masked lines that can recur, under token count and leading tokens as one key."""
    raw = base.select("id", "hash", F.posexplode(F.split("body", "\n")).alias("place", "raw"))
    line, n = F.col("line"), n_tokens(F.col("line"))
    trimmed = once(raw, "trimmed", F.btrim("raw", F.lit(BLANKS)))
    return (once(trimmed, "line", masked(F.col("trimmed")))
            .where((n >= least_tokens) & (2 * n_variables(line) <= n))
            .select("id", "hash", "place", F.xxhash64(n, F.substring_index(line, " ", depth)).alias("leaf"), "line"))


def leaves(base: DataFrame, depth: int) -> DataFrame:
    """``leaf`` of every line, those that stay anyway too, since only leading tokens are masked."""
    line = single_spaced(F.btrim("raw", F.lit(BLANKS)))
    head = F.substring_index(line, " ", depth)
    head = F.when(head.rlike("[0-9]"), variables_in(head)).otherwise(head)
    return base.select(F.explode(F.split("body", "\n")).alias("raw")).select(F.xxhash64(n_tokens(line), head).alias("leaf"))


def least_pairs(words: Column) -> Column:
    """The ``MARKS`` least hashes of word pairs, sorted as numbers; ``array_sort`` would call a function for each two."""
    pairs = let(words, lambda w: F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(1))),
                                            lambda a, b: F.xxhash64(a, b)))
    return F.slice(F.sort_array(F.array_distinct(pairs)), 1, MARKS)


def same_template(a: list[str], b: list[str], similarity: float) -> bool:
    """Enough places agree; a variable place agrees with everything."""
    equal = sum(x == y or x == VARIABLE or y == VARIABLE for x, y in zip(a, b))
    return equal >= similarity * len(a)


def blocks(tokens: list[str], depth: int, similarity: float) -> Iterator[tuple]:
    """Runs of the places after the leading ones, which a leaf has in common.

    Two lines that are similar agree in one run at least. Where so many places
    may differ that all of the rest can, every line of the leaf is similar.
    """
    rest, many = tokens[depth:], int(len(tokens) * (1 - similarity) + 1e-9) + 1
    if many > len(rest):
        yield 0, ()
        return
    for k in range(many):
        yield k, tuple(rest[k * len(rest) // many:(k + 1) * len(rest) // many])


class Leaf:
    """Templates of one leaf of the tree, in the order in which they were met."""

    def __init__(self, depth: int, similarity: float):
        self.depth, self.similarity = depth, similarity
        self.templates: list[list[str]] = []
        self.places: dict[tuple, list[int]] = {}

    def place(self, line: str) -> int:
        """Number of the line's template, which is widened where the line differs."""
        tokens = line.split(" ")
        keys = list(blocks(tokens, self.depth, self.similarity))
        for key in keys:
            for k in self.places.get(key, ()):
                have = self.templates[k]
                if same_template(have, tokens, self.similarity):
                    # A template widens up to the similarity, so that it never comes to match everything.
                    wide = [x if x == y else VARIABLE for x, y in zip(have, tokens)]
                    if wide.count(VARIABLE) <= max(have.count(VARIABLE), len(wide) // 2):
                        self.templates[k] = wide
                    return k
        self.templates.append(tokens)
        for key in keys:
            self.places.setdefault(key, []).append(len(self.templates) - 1)
        return len(self.templates) - 1


def parse(lines: DataFrame, keys: list[str], depth: int, similarity: float) -> DataFrame:
    """``leaf, line, template`` for rows ``leaf, line`` dealt by ``keys``."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leaf, held, ready = None, None, [], []

        def finish() -> None:
            ready.extend((at[0], x, " ".join(leaf.templates[k])) for x, k in held)

        def out() -> pd.DataFrame:
            rows = pd.DataFrame(ready, columns=["leaf", "line", "template"])
            ready.clear()
            return rows

        for frame in frames:
            for row in frame.itertuples(index=False):
                key = tuple(row[:-1])
                if key != at:
                    if held:
                        finish()
                    if len(ready) >= 5000:
                        yield out()
                    at, leaf, held = key, Leaf(depth, similarity), []
                held.append((row[-1], leaf.place(row[-1])))
        if held:
            finish()
        if ready:
            yield out()

    dealt = lines.select(*keys, "line").repartition(*keys).sortWithinPartitions(*keys, "line")
    return dealt.mapInPandas(run, "leaf bigint, line string, template string")


def recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", depth: int = 3,
                    similarity: float = 0.8, least_docs: int = 10, long_tokens: int = 20, long_docs: int = 5,
                    least_tokens: int = 3, own: float = 0.25) -> DataFrame:
    """``id, hash, places, templates``: which lines of which documents recur.

    A template recurs in ``least_docs`` kinds of documents, or in ``long_docs`` where
    it has ``long_tokens`` tokens.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    base = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.xxhash64(body).alias("hash"),
                       body.alias("body"))
    lines = masked_lines(base, depth, least_tokens)
    # A leaf with too few lines has too few documents; counting lines that stay anyway only keeps more leaves.
    full = (leaves(base, depth).groupBy("leaf").count()
            .where(F.col("count") >= min(least_docs, long_docs)).select("leaf"))
    found = materialize(lines.join(full.hint("merge"), "leaf", "left_semi"))

    # Two rounds: shares of a leaf, then their templates.
    each = found.select("leaf", "line").distinct().withColumn("salt", F.pmod(F.xxhash64("line"), F.lit(SALTS)))
    first = materialize(parse(each, ["leaf", "salt"], depth, similarity))
    second = parse(first.select("leaf", F.col("template").alias("line")).distinct(), ["leaf"], depth, similarity)
    named = first.join(second.select("leaf", F.col("line").alias("template"), F.col("template").alias("final")),
                       ["leaf", "template"]).select("leaf", "line", "final")
    placed = materialize(found.join(named, ["leaf", "line"]).select("id", "hash", "place", "leaf", "final"))
    who = placed.select("leaf", "final", "id", "hash").distinct()
    count = who.groupBy("leaf", "final").agg(F.count("*").alias("docs"))
    long_line = F.size(F.split("final", " ")) >= long_tokens
    wanted = F.when(long_line, F.lit(long_docs)).otherwise(F.lit(least_docs))
    many = count.where(F.col("docs") >= wanted)
    several = materialize(who.join(many, ["leaf", "final"]))
    sharing = several.select("id", "hash").distinct()
    least = least_pairs(F.split(F.replace("body", F.lit("\n"), F.lit(" ")), " "))
    marks = materialize(base.select("id", "hash", least.alias("least"))
                        .join(sharing, ["id", "hash"], "left_semi").dropDuplicates(["id", "hash"])
                        .select("id", "hash", F.explode("least").alias("mark")))
    # Marks of fewer documents than half the least number are own ones whatever the template.
    common = marks.groupBy("mark").agg(F.count("*").alias("held")).where(2 * F.col("held") >= min(least_docs, long_docs))
    marked = (marks.join(common, "mark", "left").groupBy("id", "hash")
              .agg(F.collect_list(F.struct("mark", F.coalesce("held", F.lit(1)).alias("held"))).alias("marks")))
    mine = F.filter("marks", lambda x: 2 * x["held"] < F.col("docs"))
    kind = F.when(F.size(mine) >= own * F.size("marks"), F.array_min(mine)["mark"])
    kinds = several.join(marked, ["id", "hash"], "left").select(
        "leaf", "final", "docs", F.coalesce(kind, F.lit(0).cast("bigint")).alias("kind"))
    recur = (kinds.groupBy("leaf", "final").agg(F.countDistinct("kind").alias("kinds"))
             .where(F.col("kinds") >= wanted).select("leaf", "final"))
    return (placed.join(recur, ["leaf", "final"]).groupBy("id", "hash")
            .agg(F.collect_set("place").alias("places"), F.collect_set("final").alias("templates")))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **rules) -> DataFrame:
    """``docs`` without the lines of recurring templates; ``n_chars`` follows the text."""
    gone = recurring_lines(docs, id_col, text, **rules).select(
        F.col("id").alias("_id"), F.col("hash").alias("_hash"), F.col("places").alias("_places"))
    body = F.coalesce(F.col(text), F.lit(""))
    marked = docs.join(gone, (F.coalesce(F.col(id_col).cast("string"), F.lit("")) == F.col("_id"))
                       & (F.xxhash64(body) == F.col("_hash")), "left")
    rest = F.array_join(F.filter(F.split(F.col(text), "\n"),
                                 lambda _, i: ~F.array_contains("_places", i)), "\n")
    out = marked.withColumn(text, F.when(F.col("_places").isNull(), F.col(text)).otherwise(rest))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(F.col(text)).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])

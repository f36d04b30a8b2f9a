"""Fill-in-the-middle: documents cut at two unit borders and put in another order.

A unit is a word with the white space before it; white space at the end of a
text is a unit of its own. A text is looked at in blocks of fixed length. A
Fenwick tree holds how many units begin in each block and how many code points
it has. Both cuts come from the tree by binary lifting, which leads to the block
the unit begins in; only that block is searched for the place. Units may be
longer than a block, and a text of any length needs two counts per block.

What is cut, where, and in which order follows from a hash of seed and id alone,
so a repeated task gives the same rows. Python sees the texts to find the cuts;
they are put together, and back, by column expressions.

Defined cases: a null text counts as an empty one; empty texts, and those that
contain a sentinel, stay plain; a null id is hashed like an empty string; rows with equal id
and text give equal results; an empty table gives an empty one; further columns
are carried along, those with the name of a result are replaced.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Code points of a block.
BLOCK = 4096
#: Where a unit ends and white space begins the next one.
_BORDER = re.compile(r"[^\x20\x09-\x0D][\x20\x09-\x0D]")
RESULTS = ("n", "form", "prefix_chars", "middle_chars", "output")


class Fenwick:
    """Prefix sums over the rows of a table of counts, found by binary lifting."""

    def __init__(self, counts: np.ndarray):
        rows = len(counts)
        sums = np.concatenate([np.zeros((1, counts.shape[1]), dtype=np.int64), np.cumsum(counts, axis=0)])
        at = np.arange(1, rows + 1)
        self.nodes = [(0,) * counts.shape[1], *map(tuple, (sums[at] - sums[at - (at & -at)]).tolist())]
        self.total = tuple(sums[-1].tolist())
        self.top = 1 << rows.bit_length() >> 1

    def descend(self, most: int) -> tuple[int, int, int]:
        """Rows whose first counts sum up to ``most`` at most, and both sums over them."""
        row, first, second, step = 0, 0, 0, self.top
        while step:
            if row + step < len(self.nodes) and first + self.nodes[row + step][0] <= most:
                row += step
                first += self.nodes[row][0]
                second += self.nodes[row][1]
            step >>= 1
        return row, first, second


class Units:
    """Where the units of a text begin, by blocks."""

    def __init__(self, text: str, block: int = BLOCK):
        self.text, self.block = text, block
        starts = range(0, len(text), block)
        counts = [(len(self._borders(k)) + (k == 0), min(block, len(text) - k)) for k in starts]
        self.tree = Fenwick(np.array(counts, dtype=np.int64).reshape(-1, 2))
        self.count = self.tree.total[0]

    def _borders(self, at: int, find=_BORDER.findall):
        """Borders in the block from ``at`` on; the first may begin one code point before."""
        return find(self.text, max(at - 1, 0), at + self.block)

    def place(self, unit: int) -> int:
        """Code points before the unit with this number, from 0; after the last one the whole text."""
        if unit >= self.count:
            return len(self.text)
        _, before, at = self.tree.descend(unit)
        if unit == 0:
            return 0
        local = self._borders(at, _BORDER.finditer)
        return next(islice(local, unit - before - (at == 0), None)).end() - 1


def cuts(text: str, key: str, seed: int = 42, rate: int = 50, spm: int = 80, block: int = BLOCK) -> tuple:
    """``n, form, prefix_chars, middle_chars`` of a text; ``rate`` and ``spm`` are per cent."""
    units = Units(text, block)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    n = units.count
    if not text or any(x in text for x in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return n, "plain", None, None
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, second = units.place(low), units.place(high)
    return n, "spm" if h[3] % 100 < spm else "psm", first, second - first


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 42, rate: int = 50,
                   spm: int = 80, block: int = BLOCK) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output``."""

    @F.pandas_udf("n bigint, form string, prefix_chars bigint, middle_chars bigint")
    def run(keys: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [cuts(body, key, seed, rate, spm, block) for key, body in zip(keys, texts)]
        found = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars"])
        return found.astype({"n": "int64", "form": "object", "prefix_chars": "Int64", "middle_chars": "Int64"})

    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    kept = [c for c in docs.columns if c not in RESULTS or c == text]
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    cut = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), body.alias("body"),
                      run(key, body).alias("cut"))
    first, upto = F.col("cut.prefix_chars").cast("int"), (F.col("cut.prefix_chars") + F.col("cut.middle_chars")).cast("int")
    head = F.substring(F.col("body"), F.lit(1), first)
    middle = F.substring(F.col("body"), first + 1, upto - first)
    tail = F.substring(F.col("body"), upto + 1, F.length("body"))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = (F.when(F.col("cut.form") == "spm", F.concat(s, tail, p, head, m, middle))
              .when(F.col("cut.form") == "psm", F.concat(p, head, s, tail, m, middle)).otherwise(F.col("body")))
    return cut.select(*[F.col(f"row.`{c}`") for c in kept if c not in RESULTS], *[f"cut.{c}" for c in RESULTS[:-1]],
                      output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text behind an output of :func:`fill_in_middle`; sentinels stand in no cut text."""
    def part(after: str, before: str | None) -> Column:
        rest = F.substring(output, F.instr(output, after) + len(after), F.length(output))
        return F.substring_index(rest, before, 1) if before else rest

    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, None), part(SUFFIX, PREFIX))
    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, None), part(SUFFIX, MIDDLE))
    return F.when(form == "spm", spm).when(form == "psm", psm).otherwise(output)

"""Fill-in-middle transformation: text reordered so that a model learns to write its middle.

A text's units are its words of A-Z letters and its other characters. The texts of a
batch are laid end to end and cut into fixed blocks of BLOCK bytes, none across two
texts; a Fenwick tree over the blocks holds how many units and code points begin in
each. A cut after u units is found by binary-lifting descent, which ends at the block
where unit u begins and has summed the code points before it, and is then located
among that block's bytes alone. So a cut costs the logarithm of the blocks and one
block, however long its text is.

Every draw is a digest of the seed and the row's id, so rows, partitions and reruns
do not matter. Texts are bytes from the scan to the output and are never decoded.

Defined cases: a null text counts as empty, an empty one has 0 units and stays plain;
a null id draws as an empty one; repeated rows are transformed alike; very long texts
are cut whole, a batch holds at most BATCH_ROWS of them; an empty table gives no rows;
columns named like a result (n, form, prefix_chars, middle_chars, output) are replaced,
all others are passed through. Bytes that are no UTF-8 count with the character before.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ._text import slices, small_batches

BLOCK = 512
#: The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RESULT = {"n": "long", "form": "string", "prefix_chars": "long", "middle_chars": "long", "output": "string"}

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def fenwick(counts: np.ndarray) -> np.ndarray:
    """Tree of n + 1 sums, of which the one at i covers the lowest set bit of i counts up to i."""
    tree = np.concatenate(([0], counts)).astype(np.int64)
    step = 1
    while 2 * step < len(tree):
        at = np.arange(2 * step, len(tree), 2 * step)
        tree[at] += tree[at - step]
        step *= 2
    return tree


class BlockTree:
    """Units and code points of texts laid end to end."""

    def __init__(self, texts: list[bytes], block: int = BLOCK):
        buf = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        n_blocks = -(-sizes // block)
        self.first = np.concatenate(([0], np.cumsum(n_blocks)))
        within = np.arange(self.first[-1]) - np.repeat(self.first[:-1], n_blocks)
        self.starts = np.append(np.repeat(self.begins[:-1], n_blocks) + within * block, len(buf))
        letter, heads = _LETTER[buf], self.begins[:-1][sizes > 0]
        self.lead = (buf & 0xC0) != 0x80
        self.lead[heads] = True
        self.unit = self.lead.copy()
        self.unit[1:] &= ~(letter[1:] & letter[:-1])
        self.unit[heads] = True
        self.block = block
        if len(buf):
            self.units, self.points = (fenwick(np.add.reduceat(x, self.starts[:-1], dtype=np.int64)) for x in (self.unit, self.lead))
        else:
            self.units = self.points = np.zeros(1, np.int64)

    def before(self, block: np.ndarray) -> np.ndarray:
        """Units before each block."""
        total, at = np.zeros(len(block), np.int64), block.copy()
        while at.any():
            total += self.units[at]
            at &= at - 1
        return total

    def locate(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(byte, code points before it) where the unit of each number begins; the end for the number of all units."""
        n = len(self.units) - 1
        at, left, points = np.zeros(len(rank), np.int64), rank.copy(), np.zeros(len(rank), np.int64)
        step = 1 << max(n.bit_length() - 1, 0)
        while step:
            reach = np.minimum(at + step, n)
            go = (at + step <= n) & (self.units[reach] <= left)
            left -= np.where(go, self.units[reach], 0)
            points += np.where(go, self.points[reach], 0)
            at += np.where(go, step, 0)
            step >>= 1
        place, inside = self.starts[at].copy(), np.flatnonzero(at < n)
        if len(inside):
            own = at[inside]
            here = self.starts[own, None] + np.arange(self.block)
            valid = here < self.starts[own + 1, None]
            here = np.minimum(here, len(self.unit) - 1)
            offset = np.argmax(np.cumsum(self.unit[here] & valid, 1) > left[inside, None], 1)
            place[inside] += offset
            points[inside] += np.count_nonzero(self.lead[here] & (np.arange(self.block) < offset[:, None]), 1)
        return place, points


def draws(seed: int, row: object) -> tuple[int, int, int, int]:
    """Four 32-bit numbers of the row: its two cuts, whether it is transformed, and how."""
    return struct.unpack_from(">4I", hashlib.sha256(f"{seed}:{'' if row is None else row}".encode()).digest())


def transform(texts: list[bytes], rows: list, *, seed: int, fim_percent: int, spm_percent: int, block: int = BLOCK) -> list[tuple]:
    """(n, form, prefix_chars, middle_chars, output) of each text."""
    tree = BlockTree(texts, block)
    base = tree.before(tree.first)
    n = np.diff(base)
    drawn = [draws(seed, x) for x in rows]
    cuts = np.array([sorted((h[0] % (k + 1), h[1] % (k + 1))) for h, k in zip(drawn, n.tolist(), strict=True)], np.int64).reshape(-1, 2)
    # The end of a text is where the next text's first unit begins.
    place, points = tree.locate(np.concatenate((base[:-1], base[:-1] + cuts[:, 0], base[:-1] + cuts[:, 1])))
    first, one, two = points.reshape(3, -1)
    _, a, b = place.reshape(3, -1) - tree.begins[:-1]
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    out = []
    for i, (text, h) in enumerate(zip(texts, drawn, strict=True)):
        if not text or h[2] % 100 >= fim_percent or p in text or s in text or m in text:
            out.append((int(n[i]), "plain", None, None, text))
            continue
        x, y, z = text[: a[i]], text[a[i] : b[i]], text[b[i] :]
        form, parts = ("spm", (s, z, p, x, m, y)) if h[3] % 100 < spm_percent else ("psm", (p, x, s, z, m, y))
        out.append((int(n[i]), form, int(one[i] - first[i]), int(two[i] - one[i]), b"".join(parts)))
    return out


def fill_in_middle(docs: DataFrame, *, seed: int = 1, fim_percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``docs(doc_id, text, ..)`` with n units, the form (plain, psm, spm), the parts' code points and the transformed text."""
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in RESULT]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch["text"].cast(pa.binary())
            for a, b in slices(text):
                part = batch.slice(a, b - a)
                rows = transform([x or b"" for x in text[a:b].to_pylist()], part["doc_id"].to_pylist(), seed=seed, fim_percent=fim_percent, spm_percent=spm_percent)
                columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
                columns[-1] = columns[-1].cast(pa.string(), safe=False)
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*kept, *RESULT])

    schema = StructType([*docs.schema.fields])
    for name, kind in RESULT.items():
        schema = schema.add(name, kind)
    return docs.mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` of this form was made of; a transformed text holds each mark once."""
    middle = F.substring_index(output, MIDDLE, -1)
    head = F.substring_index(output, MIDDLE, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, SUFFIX, 1), PREFIX, -1), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, F.substring_index(F.substring_index(head, PREFIX, 1), SUFFIX, -1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def digest(done: DataFrame) -> DataFrame:
    """Checksums of the output and of the text rebuilt from it."""
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
c AS (SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS c2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
p AS (SELECT doc_id, n, x, array_to_string(u[1:least(c1, c2)], '') AS p, array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS m, array_to_string(u[greatest(c1, c2) + 1:n], '') AS s,
             CASE WHEN x = '' OR contains(x, '<P>') OR contains(x, '<S>') OR contains(x, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN x WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(x) AS restored_sha256
FROM p
"""

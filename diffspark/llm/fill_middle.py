"""Fill-in-middle by block rotation inside one buffer, and its exact inverse.

A text of n lines is cut after two keyed numbers of lines into prefix, middle and suffix.
The three sentinels are inserted in text order, ``<P>`` prefix ``<M>`` middle ``<S>`` suffix, in
a bytearray. The other orders are rotations of neighbouring blocks in place, each made of three
reversals (both blocks, then both together):

* psm swaps the middle block with the suffix block;
* spm swaps everything before the suffix block with it, which is the whole buffer.

:func:`restore` gets output and form only: it finds the sentinels, rotates back and deletes
them. No text that is cut contains a sentinel, and a sentinel cannot overlap another one, so each
is found exactly once. A reversal moves bytes in blocks of STEP from both ends: beside the buffer
it needs a constant amount of memory.

Cases: null and empty texts, and texts that hold a sentinel, stay as they are (form ``plain``,
sizes null, the output is the text, null as empty). A null ``doc_id`` is keyed as the empty string.
Rows are independent: repeats and ties get equal results, an empty table gives no rows. Texts of
any length are cut whole. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffspark.llm.common import ship, table

ship(__name__)

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
MARK = len(PREFIX)
SENTINEL = re.compile(b"<[PSM]>")
LINE_END = re.compile(b"\n")
PLAIN, PSM, SPM = "plain", "psm", "spm"
STEP = 1 << 16


def reverse(buffer: bytearray, i: int, j: int) -> None:
    """Reverse ``buffer[i:j]`` in place."""
    while j - i > 1:
        k = min(STEP, (j - i) // 2)
        buffer[i : i + k], buffer[j - k : j] = buffer[j - k : j][::-1], buffer[i : i + k][::-1]
        i, j = i + k, j - k


def rotate(buffer: bytearray, i: int, m: int, j: int) -> None:
    """Swap the neighbouring blocks ``buffer[i:m]`` and ``buffer[m:j]`` in place."""
    reverse(buffer, i, m)
    reverse(buffer, m, j)
    reverse(buffer, i, j)


def line_ends(buffer: bytearray) -> list[int]:
    """Where the lines end (a line feed belongs to its line), after a leading 0."""
    ends = [0, *(m.end() for m in LINE_END.finditer(buffer))]
    if ends[-1] != len(buffer):
        ends.append(len(buffer))
    return ends


def keys(doc_id: int | None, seed: int) -> list[int]:
    """Four 32-bit numbers drawn from seed and id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def characters(buffer: bytearray, i: int, j: int) -> int:
    return len(buffer[i:j].decode("utf-8", "surrogatepass"))


def cut(buffer: bytearray, doc_id: int | None, seed: int, rate: int, spm: int) -> tuple:
    """Turn a text into its output, in place: (n, form, prefix_chars, middle_chars)."""
    ends = line_ends(buffer)
    n = len(ends) - 1
    h1, h2, h3, h4 = keys(doc_id, seed)
    if not n or h3 % 100 >= rate or SENTINEL.search(buffer):
        return n, PLAIN, None, None
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[a], ends[b]
    sizes = characters(buffer, 0, a), characters(buffer, a, b)
    buffer[b:b] = SUFFIX
    buffer[a:a] = MIDDLE
    buffer[0:0] = PREFIX
    m, s = a + MARK, b + 2 * MARK  # starts of the middle and the suffix block
    if h4 % 100 < spm:
        rotate(buffer, 0, s, len(buffer))
        # <S> suffix <P> prefix <M> middle
        return n, SPM, *sizes
    rotate(buffer, m, s, len(buffer))
    return n, PSM, *sizes


def uncut(buffer: bytearray, form: str) -> None:
    """Turn an output back into its text, in place."""
    if form == PLAIN:
        return
    if form == SPM:
        rotate(buffer, 0, buffer.index(PREFIX), len(buffer))
    else:
        rotate(buffer, buffer.index(SUFFIX), buffer.index(MIDDLE), len(buffer))
    s, m = buffer.index(SUFFIX), buffer.index(MIDDLE)
    del buffer[s : s + MARK]
    del buffer[m : m + MARK]
    del buffer[:MARK]


OUTPUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def _buffers(column) -> Iterator[bytearray]:
    for value in column:
        yield bytearray() if not value.is_valid else bytearray(value.as_buffer())


def cut_batches(batches: Iterator[pa.RecordBatch], seed: int, rate: int, spm: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, rows, out = batch.column("doc_id"), [], []
        for doc_id, buffer in zip(ids.to_pylist(), _buffers(batch.column("text")), strict=True):
            rows.append(cut(buffer, doc_id, seed, rate, spm))
            out.append(buffer.decode("utf-8", "surrogatepass"))
        n, form, before, middle = zip(*rows, strict=True) if rows else ((),) * 4
        yield pa.RecordBatch.from_arrays(
            [
                ids,
                pa.array(n, pa.int64()),
                pa.array(form, pa.string()),
                pa.array(before, pa.int64()),
                pa.array(middle, pa.int64()),
                pa.array(out, pa.string()),
            ],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
        )


def uncut_batches(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for form, buffer in zip(batch.column("form").to_pylist(), _buffers(batch.column("output")), strict=True):
            uncut(buffer, form)
            texts.append(buffer.decode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names)


def fill_in_middle(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50) -> DataFrame:
    """One row per document: doc_id, n (lines), form, prefix_chars, middle_chars, output (text).

    ``rate`` per cent of the documents are cut, ``spm`` per cent of these with the suffix first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(partial(cut_batches, seed=seed, rate=rate, spm=spm), OUTPUT)


def restore(outputs: DataFrame, out: str = "restored") -> DataFrame:
    """Adds the text that ``output`` and ``form`` stand for."""
    names = [*outputs.columns, out]
    schema = T.StructType([*outputs.schema.fields, T.StructField(out, T.StringType())])
    return outputs.mapInArrow(partial(uncut_batches, names=names), schema)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, half of them suffix first, with digests of output and restored text."""
    both = restore(fill_in_middle(table(spark, sf_dir, "documents")))
    return both.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"),
    )


SQL = {
    "op13_fill_in_middle": r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units
  FROM documents
), k AS (
  SELECT *, CAST(len(units) AS BIGINT) AS n,
         CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
         CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                   OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM k
), p AS (
  SELECT *, coalesce(array_to_string(units[1:a], ''), '') AS prefix,
         coalesce(array_to_string(units[a + 1:b], ''), '') AS middle,
         coalesce(array_to_string(units[b + 1:n], ''), '') AS suffix
  FROM c
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
}

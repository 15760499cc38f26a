"""Fill-in-the-middle rearrangement as a pyarrow.compute pipeline over batches.

A text is a row of units (runs of ASCII letters, or single other code points). For every batch: split the
units into list arrays, flatten them with their parent indices, compute each unit's ordinal in its text,
filter the units by role (prefix, middle, suffix), rebuild a list array for each role, and join its pieces
with ``binary_join``. Where a text is cut is a hash of its id, made by Spark; no step loops over units.

Scale: a map without any shuffle. A text of more than ``LIMIT`` bytes goes through the pipeline in segments
that end between units, so memory follows ``LIMIT`` and the longest text itself, not its number of units.

Cases: a NULL or empty text is plain and empty. A NULL id hashes as the word ``null``. Bytes that are no
UTF-8 are replaced first (U+FFFD). Texts that contain a marker stay plain, so that every output can be
taken apart again (``restore``). Repeated rows and empty tables need nothing special.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import binary_list, per_batch, schema_with
from .words import chunks

#: A unit, over the bytes of valid UTF-8: letters, one other ASCII byte, or one longer code point.
UNIT = rb"[A-Za-z]+|[\x00-\x40\x5B-\x60\x7B-\x7F]|[\xC0-\xFF][\x80-\xBF]*"
_BREAK = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F\xC0-\xFF]")  # a unit starts at each of these
_END = b"\xff"  # no byte of valid UTF-8
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LIMIT = 1 << 20
PLAIN_FROM, SPM_BELOW = 90, 20  # percent
SEED = "1:"


def draws(id_col: Column, seed: str = SEED) -> Column:
    """Four numbers below 2^32 from the sha256 of seed and id."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(id_col.cast("string"), F.lit("null"))).cast("binary"), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)])


def _segments(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Texts in segments of about ``LIMIT`` bytes that end between units, and the text of each segment."""
    parts, parents = [], []
    for i, text in enumerate(texts):
        start = 0
        while len(text) - start > LIMIT:
            found = _BREAK.search(text, start + LIMIT)
            end = found.start() if found else len(text)
            parts.append(text[start:end])
            parents.append(i)
            start = end
        if start < len(text) or not start:
            parts.append(text[start:])
            parents.append(i)
    return parts, np.array(parents, dtype=np.int64)


def _joined(values: pa.Array, counts: np.ndarray) -> pa.Array:
    """Lists of ``counts`` values each, every list joined."""
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), pa.scalar(b"", pa.binary()))


def cut(texts: list[bytes], first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
    """Units of each text, and its prefix, middle and suffix: the borders are ``first`` and ``second`` modulo
    the number of units plus one, the smaller one first."""
    parts, parent = _segments(texts)
    held = pa.array(parts, pa.binary())
    counts = pc.count_substring_regex(held, pattern=UNIT).to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.bincount(parent, weights=counts, minlength=len(texts)).astype(np.int64)
    low, high = np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))
    before = np.cumsum(counts) - counts  # units of earlier segments, of all texts
    before -= np.concatenate([[0], np.cumsum(n)])[parent]
    pieces: list[list[pa.Array]] = [[], [], []]
    for a, b in chunks(parts, LIMIT):
        lists = pc.split_pattern(pc.replace_substring_regex(held.slice(a, b - a), pattern=UNIT, replacement=b"\\0" + _END), pattern=_END)
        flat, owner = pc.list_flatten(lists), pc.list_parent_indices(lists).to_numpy()
        starts = lists.offsets.to_numpy().astype(np.int64)
        ordinal = np.arange(len(flat), dtype=np.int64) - (starts[:-1] - starts[0])[owner]
        real = ordinal < counts[a:b][owner]  # the end mark of the last unit leaves an empty element behind
        ordinal += before[a:b][owner]
        text = parent[a:b][owner]
        role = np.where(ordinal < low[text], 0, np.where(ordinal < high[text], 1, 2))
        for r in range(3):
            chosen = real & (role == r)
            pieces[r].append(_joined(flat.filter(pa.array(chosen)), np.bincount(owner[chosen], minlength=b - a)))
    per_text = np.bincount(parent, minlength=len(texts))
    return n, [_joined(pa.chunked_array(p, pa.binary()).combine_chunks(), per_text) if len(per_text) else pa.array([], pa.binary()) for p in pieces]


def rearrange(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = SEED) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output."""
    text = F.make_valid_utf8(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.cast("binary").alias("text"), draws(F.col(f"`{id_col}`"), seed).alias("draws"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def work(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        texts = binary_list(batch["text"])
        h = pc.list_flatten(batch["draws"]).to_numpy().reshape(-1, 4)
        n, (prefix, middle, suffix) = cut(texts, h[:, 0], h[:, 1])
        whole = pa.array(texts, pa.binary())
        plain = pc.equal(pc.binary_length(whole), 0)
        for mark in (PREFIX, SUFFIX, MIDDLE):
            plain = pc.or_(plain, pc.match_substring(whole, pattern=mark))
        plain = pc.or_(plain, pa.array(h[:, 2] % 100 >= PLAIN_FROM))
        spm = pa.array(h[:, 3] % 100 < SPM_BELOW)
        mark = {m: pa.scalar(m.encode(), pa.binary()) for m in (PREFIX, SUFFIX, MIDDLE)}
        end = pa.scalar(b"", pa.binary())
        made = {
            "spm": pc.binary_join_element_wise(mark[SUFFIX], suffix, mark[PREFIX], prefix, mark[MIDDLE], middle, end),
            "psm": pc.binary_join_element_wise(mark[PREFIX], prefix, mark[SUFFIX], suffix, mark[MIDDLE], middle, end)}
        length = lambda x: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x.cast(pa.string())).cast(pa.int64()))
        return {"doc_id": batch["doc_id"], "n": pa.array(n), "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")),
                "prefix_chars": length(prefix), "middle_chars": length(middle),
                "output": pc.if_else(plain, whole, pc.if_else(spm, made["spm"], made["psm"])).cast(pa.string())}

    return rows.mapInArrow(per_batch(work, names), schema_with(rows, "n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"))


def restore(output: Column, form: Column) -> Column:
    """The text again, from an output and its form. Markers are unambiguous: none is in a text that was
    rearranged, and no marker begins with what another one ends with."""
    part = F.split(F.substr(output, F.lit(len(PREFIX) + 1)), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda i: F.get(part, F.lit(i))
    return F.when(form == "psm", F.concat(at(0), at(2), at(1))).when(form == "spm", F.concat(at(1), at(2), at(0))).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"),
                       sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))


def sql() -> str:
    h = [f"CAST('0x' || substr(d, {8 * i + 1}, 8) AS BIGINT)" for i in range(4)]
    return f"""
    WITH a AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS d FROM documents),
    b AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS u, {h[0]} AS h1, {h[1]} AS h2, {h[2]} AS h3, {h[3]} AS h4 FROM a),
    c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS lo, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS hi,
            CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {PLAIN_FROM}
              THEN 'plain' WHEN h4 % 100 < {SPM_BELOW} THEN 'spm' ELSE 'psm' END AS form FROM b),
    e AS (SELECT *, array_to_string(u[1:lo], '') AS p, array_to_string(u[lo + 1:hi], '') AS m, array_to_string(u[hi + 1:n], '') AS s FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
           sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
                  ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
           sha256(text) AS restored_sha256 FROM e"""

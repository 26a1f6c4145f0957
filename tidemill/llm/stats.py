"""Statistics of whole texts, computed in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemill.llm import words as w

SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Further counts of a text. A run word equals the word before it; a cap word has two or more
#: capitals of A-Z and no small letter of a-z; a stop word has at most three characters.
EXTRA = ["n_chars", "n_lines", "n_upper", "n_digits", "n_punct", "n_pipes", "n_bangs", "n_run_words", "n_distinct_words", "n_cap_words", "n_short_words", "n_long_words", "n_wide"]


def _flags(chars: bytes) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars)] = True
    return table


_SYMBOL, _UPPER, _LOWERS = _flags(SYMBOLS), _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
_DIGIT, _PUNCT = _flags(b"0123456789"), _flags(b".,;:!?'\"()-")
_PIPE, _BANG, _LINE, _HEAD = _flags(b"|"), _flags(b"!"), _flags(b"\n"), _flags(bytes([*range(0x80), *range(0xC0, 0x100)]))


def _dup_lines(text: bytes | None) -> int:
    if not text or b"\n" not in text:
        return 0
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measure(texts: list[bytes | None], extra: bool) -> dict[str, np.ndarray]:
    """The counts of each text, as arrays. A null text is like an empty one."""
    c = w.cut(texts, w.SPACED, lower=False)
    data = np.frombuffer(c.data, dtype=np.uint8)
    limits = np.minimum(c.bounds, len(data))
    ends = np.maximum(c.bounds[1:] - 1, 0)

    def per_text(flags: np.ndarray) -> np.ndarray:
        found = np.flatnonzero(flags[data])
        return np.searchsorted(found, ends) - np.searchsorted(found, limits[:-1])

    def running(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(flags[data], out=total[1:])
        return total

    heads = running(_HEAD)
    size = heads[c.end] - heads[c.start]
    h = w.word_hashes(c)
    owner = c.owner
    grams, at = w.shingle_hashes(c, h, 3)
    own = w.mix(grams + owner[at].astype(np.uint64) * w._B)
    again = at[w.repeated(own)]
    covered = np.zeros(len(h) + 3, dtype=bool)
    for j in range(3):
        covered[again + j] = True
    out = {
        "n_words": c.counts.astype(np.int64),
        "word_chars": w.sums(size, c.first),
        "n_symbols": per_text(_SYMBOL),
        "n_dup_lines": np.fromiter((_dup_lines(t) for t in texts), dtype=np.int64, count=len(texts)),
        "n_repeat_words": w.sums(covered[: len(h)], c.first),
    }
    if not extra:
        return out
    run = np.zeros(len(h), dtype=bool)
    run[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    distinct = np.zeros(len(texts), dtype=np.int64)
    for i, (a, b) in enumerate(zip(c.first[:-1].tolist(), c.first[1:].tolist())):
        if b > a:
            own = np.sort(h[a:b])
            distinct[i] = 1 + np.count_nonzero(own[1:] != own[:-1])

    def per_word(flags: np.ndarray) -> np.ndarray:
        total = running(flags)
        return total[c.end] - total[c.start]

    upper, lower = per_word(_UPPER), per_word(_LOWERS)
    out |= {
        "n_chars": heads[ends] - heads[limits[:-1]],
        "n_lines": per_text(_LINE) + 1,
        "n_upper": per_text(_UPPER),
        "n_digits": per_text(_DIGIT),
        "n_punct": per_text(_PUNCT),
        "n_pipes": per_text(_PIPE),
        "n_bangs": per_text(_BANG),
        "n_run_words": w.sums(run, c.first),
        "n_distinct_words": distinct,
        "n_cap_words": w.sums((upper >= 2) & (lower == 0), c.first),
        "n_short_words": w.sums(size <= 3, c.first),
        "n_long_words": w.sums(size >= 12, c.first),
        "n_wide": heads[ends] - heads[limits[:-1]] - per_text(_flags(bytes(range(0x80)))),
    }
    return out


def text_stats(docs: DataFrame, keep: list[str], text: str = "text", extra: bool = False) -> DataFrame:
    """``keep`` columns of ``docs`` under the names ``k0``, ``k1``, ... and the counts of each whole text.

    One row per input row; extra columns of ``docs`` are not read, so their names cannot clash.
    """
    names = COUNTS + (EXTRA if extra else [])
    source = docs.select(*[docs[x].alias(f"k{i}") for i, x in enumerate(keep)], docs[text].cast("string").alias("text"))
    fields = [f for f in source.schema.fields if f.name != "text"]
    kept = [f.name for f in fields]
    kinds = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in fields] + [f"{x} bigint" for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in w.chunks(batches, "text"):
            found = measure(texts, extra)
            yield pa.RecordBatch.from_arrays([part.column(x) for x in kept] + [pa.array(found[x].astype(np.int64)) for x in names], names=kept + names)

    return source.mapInArrow(run, kinds)

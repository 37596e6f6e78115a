"""Token ids of whole texts, in Arrow batches, with the ids of repeated words looked up.

Both public tokenizers split a text into words first and merge inside a word only. A word
never reaches over the border between a visible character and a following blank or line
break, nor from a letter or digit to a punctuation mark that ends the word, so a text may be
cut there and its pieces encoded apart. Every distinct piece of a batch is encoded once by
the tokenizers library, several in one call with a border between them: a sign that is one
token after a blank, or a special token where a piece has no blank before it. Texts are then
put together by numpy gathers. Texts with doubled blanks or other white space, and texts that
contain the border's sign or a special token's string, are given to the library whole.

What a worker remembers is bounded and outlives a task; ``lean`` returns the memory
that a task's batches have taken.
"""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache, wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_OTHER_SPACE = re.compile(r"[^\S \n]|[\x00-\x09\x0b-\x1f\x7f-\x9f᠎​-‏⁠﻿]")
#: Bytes that neither are control characters nor begin the code of other white space.
_SAFE_BYTES = bytes(b for b in range(256) if b == 10 or (b >= 32 and b not in (0x7F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF)))
#: Stands before a piece that follows the one before it without a blank; no regular text holds it.
_GLUE = "\x02"
#: A mark that ends a word, after a letter or digit that both tokenizers know as such.
_ENDING = re.compile(r"([.,;:!?)])(?=[ \n])(?<=[A-Za-z0-9À-ÖØ-öø-ÿ].)")
_SIGNS = "¥£®©×µ"
_REMEMBERED = 300_000
_BATCH_CHARS = 1_000_000
_JOINED = 500

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """A tokenizer file with a bounded memory of the words it has encoded."""

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        told = json.loads(self._tokenizer.to_str())
        added = told["added_tokens"]
        self._special = [t["content"] for t in added]
        plain = [t for t in added if t["special"] and not t["normalized"]
                 and not (t["lstrip"] or t["rstrip"] or t["single_word"])]
        self._border = (plain[0]["content"], plain[0]["id"]) if plain else None
        # Its ids do not depend on the case of A to Z.
        self._folds = '"Lowercase"' in json.dumps(told["normalizer"])
        signs = [(f" {c}", ids[0]) for c in _SIGNS if len(ids := self._whole([f" {c}"])[0]) == 1]
        self._sign = signs[0] if signs else self._border
        if signs:
            self._special.append(signs[0][0][1])
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids = np.empty(0, np.uint32)
        self._starts = np.empty(0, np.int32)
        self._sizes = np.empty(0, np.int32)
        self._uses = np.empty(0, np.int64)

    def _thin_out(self) -> None:
        """Keeps the half of the words that was used most."""
        keep = np.sort(np.argpartition(-self._uses, _REMEMBERED // 2)[:_REMEMBERED // 2])
        place = np.full(len(self._uses), -1)
        place[keep] = np.arange(len(keep))
        self._known = {w: int(place[k]) for w, k in self._known.items() if place[k] >= 0}
        starts, sizes = self._starts[keep], self._sizes[keep]
        ends = np.cumsum(sizes)
        self._ids = self._ids[np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1])]
        self._starts, self._sizes, self._uses = (ends - sizes).astype(np.int32), sizes, self._uses[keep] // 2

    def _whole(self, texts: Sequence[str]) -> list[list[int]]:
        return [e.ids for e in self._tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _apart(self, pieces: list[str], border: tuple[str, int] | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and their number per piece; no piece holds the border."""
        if border is None:
            lists = self._whole(pieces)
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            return np.fromiter((i for ids in lists for i in ids), np.uint32, int(sizes.sum())), sizes
        mark, mark_id = border
        joined = [mark.join(pieces[k:k + _JOINED]) + mark for k in range(0, len(pieces), _JOINED)]
        flat = np.concatenate([np.asarray(ids, np.uint32) for ids in self._whole(joined)])
        ends = np.flatnonzero(flat == mark_id)
        return flat[flat != mark_id], np.diff(ends, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        """A word that neither begins a line nor is glued follows a blank in the text."""
        words.sort(key=lambda w: w[0] == _GLUE)
        glued = sum(w[0] == _GLUE for w in words)
        flat, sizes = self._apart([w if w[0] == "\n" else " " + w for w in words[:len(words) - glued]], self._sign)
        if glued:
            more, more_sizes = self._apart([w[1:] for w in words[len(words) - glued:]], self._border)
            flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, more_sizes])
        base = len(self._ids)
        self._known.update(zip(words, range(len(self._sizes), len(self._sizes) + len(words))))
        self._ids = np.concatenate([self._ids, flat])
        self._starts = np.concatenate([self._starts, (base + np.cumsum(sizes) - sizes).astype(np.int32)])
        self._sizes = np.concatenate([self._sizes, sizes.astype(np.int32)])
        self._uses = np.concatenate([self._uses, np.zeros(len(words), np.int64)])

    def _regular(self, text: str) -> bool:
        if not text or text[0] in " \n" or "  " in text or " \n" in text or "\n " in text \
                or "\n\n" in text or text[-1] in " \n":
            return False
        if text.encode("utf-8", "surrogatepass").translate(None, _SAFE_BYTES) and _OTHER_SPACE.search(text):
            return False
        return not any(s in text for s in self._special)

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        if len(self._known) > _REMEMBERED:
            self._thin_out()
        regular = [k for k, t in enumerate(texts) if self._regular(t)]
        other = sorted(set(range(len(texts))) - set(regular))
        pieces = [_ENDING.sub(rf" {_GLUE}\1", texts[k]).replace("\n", " \n") for k in regular]
        if self._folds:
            pieces = [p.encode().lower().decode() for p in pieces]
        # The first word of a text has no blank before it, so it is encoded apart.
        cut = pc.split_pattern(pa.array(pieces, pa.large_string()), " ")
        counts = np.diff(cut.offsets.to_numpy())
        coded = cut.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = self._known
        new = [w for w in words if w not in known]
        if new:
            self._learn(new)
        at = np.fromiter(map(known.__getitem__, words), np.int32, len(words))[coded.indices.to_numpy()]
        self._uses += np.bincount(at, minlength=len(self._uses))
        heads = np.cumsum(counts) - counts
        first = [p.split(" ", 1)[0] for p in pieces]
        first_ids, first_sizes = self._apart(first, self._border) if first else (np.empty(0, np.uint32), np.empty(0, np.int64))
        sizes, starts = self._sizes[at], self._starts[at]
        sizes[heads] = first_sizes
        starts[heads] = len(self._ids) + np.cumsum(first_sizes) - first_sizes
        ends = np.cumsum(sizes, dtype=np.int32)
        total = int(ends[-1]) if len(ends) else 0
        pool = np.concatenate([self._ids, first_ids])
        flat = pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(total, dtype=np.int32)]
        borders = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        lengths = np.zeros(len(texts), np.int64)
        lengths[regular] = np.diff(borders)
        if other:
            parts: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
            for k, part in zip(regular, np.split(flat, borders[1:-1])):
                parts[k] = part
            for k, ids in zip(other, self._whole([texts[k] for k in other])):
                parts[k], lengths[k] = np.asarray(ids, np.uint32), len(ids)
            flat = np.concatenate(parts)
        return flat, lengths


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a tokenizer file, loaded once per process."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


@cache
def _c_library() -> ctypes.CDLL | None:
    try:
        library = ctypes.CDLL("libc.so.6")
    except OSError:
        return None
    return library if hasattr(library, "malloc_trim") else None


def lean(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of a task's batches that, after the last one, returns freed memory to the system.

    Workers live on from stage to stage; what their allocators keep would add up to the next stage's needs."""
    @wraps(function)
    def passed_on(batches: Iterator) -> Iterator:
        yield from function(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if (library := _c_library()) is not None:
            library.malloc_trim(0)

    return passed_on


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """From now on the session sends rows to Python in batches of at most ``size`` bytes, and a row at least.

    Ten thousand rows, Spark's own bound, are many if texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def slices(texts: Sequence[str | None], chars: int = _BATCH_CHARS) -> Iterator[slice]:
    """Cuts a batch where its texts reach a number of characters, to bound memory."""
    start = held = 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= chars:
            yield slice(start, k + 1)
            start, held = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def encode_texts(path: str, texts: Sequence[str | None], end_id: int | None) -> Iterator[tuple[int, np.ndarray]]:
    """Index and ids of each text in order; null counts as empty, ``end_id`` closes each."""
    tail = np.empty(0, np.uint32) if end_id is None else np.asarray([end_id], np.uint32)
    for part in slices(texts):
        flat, lengths = encoder(path).encode([t or "" for t in texts[part]])
        ends = np.cumsum(lengths)
        for k, (end, size) in enumerate(zip(ends, lengths)):
            yield part.start + k, np.concatenate([flat[end - size:end], tail])

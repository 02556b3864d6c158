"""Exact token counts of whole texts: batch encoding in Arrow, lengths only."""

from __future__ import annotations

import json
import os
import re
import sys
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import append, field, spans_of

#: bytes of new text given to the encoder at once
BATCH_BYTES = 1 << 18
#: a text longer than this many characters is worked through in sections
SECTION_CHARS = 1 << 20
#: bytes of pieces, with their places in a table, that a worker remembers before it starts anew
REMEMBERED_BYTES = 128 << 20
#: bytes that a piece's place in the table and its count take
_PLACE = 120

_SAFE = re.compile(r"(?<=\S)(?= )")
_UNSAFE_SPACE = re.compile(r"\s ")
_workers: dict[bytes, object] = {}


def read_vocabulary(path: str) -> tuple[str, bytes]:
    """``(kind, bytes)`` of a tokenizer file: ``.json`` for tokenizers, ``.model`` for sentencepiece.

    The driver reads the file and sends its bytes to the tasks (a megabyte or two, whatever
    the size of the texts), so executors need no copy of it.
    """
    kind = os.path.splitext(path)[1].lstrip(".")
    if kind not in ("json", "model"):
        raise ValueError(f"{path}: a .json or .model tokenizer file is needed")
    with open(path, "rb") as f:
        return kind, f.read()


def splits_safely(vocabulary: dict) -> bool:
    """True if a text may be cut in front of a space that follows another character.

    That holds for byte-level BPE with the usual split pattern: none of its pieces holds white
    space behind anything else, its only look-ahead sees no further than a run of white space,
    and no added token reaches over white space.
    """
    pre = vocabulary.get("pre_tokenizer") or {}
    added = vocabulary.get("added_tokens") or []
    return (
        pre.get("type") == "ByteLevel"
        and pre.get("use_regex", True)
        and not pre.get("add_prefix_space")
        and not vocabulary.get("normalizer")
        and not vocabulary.get("model", {}).get("dropout")
        and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in added)
    )


def sections(text: str, limit: int = SECTION_CHARS) -> Iterator[str]:
    """``text`` in parts of about ``limit`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > limit:
        cut = next((m.start() for m in _SAFE.finditer(text, start + limit)), len(text))
        yield text[start:cut]
        start = cut
    yield text[start:]


def split(text: str) -> tuple[str, list[str]]:
    """The first piece of a text, and its other pieces without the space each begins with."""
    if _UNSAFE_SPACE.search(text) is None:
        first, *rest = text.split(" ")
        return first, rest
    first, *rest = _SAFE.split(text)
    return first, [p[1:] for p in rest]


class PieceCounter:
    """Counts tokens through the pieces between safe boundaries, each piece encoded once.

    Running text repeats its words, so most pieces are known already; new ones are encoded in
    batches of about ``BATCH_BYTES`` bytes.
    """

    def __init__(self, encode_lengths: Callable[[list[str]], list[int]]):
        self.encode_lengths = encode_lengths
        self.first: dict[str, int] = {}
        self.later: dict[str, int] = {}
        self.held = 0

    def learn(self, known: dict[str, int], pieces: set[str], lead: str) -> None:
        new = [p for p in pieces if p not in known]
        self.held += sum(map(sys.getsizeof, new)) + _PLACE * len(new)
        for i, j in spans_of([len(p) for p in new], BATCH_BYTES):
            known.update(zip(new[i:j], self.encode_lengths([lead + p for p in new[i:j]])))

    def counts(self, texts: list[str]) -> list[int]:
        if self.held > REMEMBERED_BYTES:
            self.first, self.later, self.held = {}, {}, 0
        cut = [split(t) for t in texts]
        self.learn(self.first, {a for a, _ in cut}, "")
        self.learn(self.later, set().union(*[b for _, b in cut]), " ")
        first, later = self.first, self.later.__getitem__
        return [first[a] + sum(map(later, b)) for a, b in cut]


def _counter(kind: str, data: bytes) -> tuple[Callable[[list[str]], list[int]], bool]:
    """``(texts -> counts, whether long texts may be cut)``; kept while the worker lives."""
    if data in _workers:
        return _workers[data]
    if kind == "json":
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_str(data.decode("utf-8"))
        tokenizer.no_truncation()
        tokenizer.no_padding()

        def lengths(texts: list[str]) -> list[int]:
            return [len(e) for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        safe = splits_safely(json.loads(data))
        made = (PieceCounter(lengths).counts if safe else lengths, safe)
    else:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_proto=data)
        made = (lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)], False)
    _workers.clear()
    _workers[data] = made
    return made


def token_counts(df: DataFrame, path: str, text: str = "text", limit: int | None = None) -> DataFrame:
    """``df`` plus ``n_bytes``, ``n_tokens`` and, with ``limit``, ``over_limit`` (more tokens than that).

    No special tokens are added; special strings inside a text count as the file's own default
    says. No truncation, no padding. A null or empty text has 0 bytes and 0 tokens. Texts of
    any length are worked through whole: encoder calls get about equal bytes, and a long text
    is cut only where its tokens cannot notice. A vocabulary for which no such place is known
    gets whole texts. No rows give no rows. Columns of ``df`` with these names are replaced.
    """
    kind, data = read_vocabulary(path)
    sent = df.sparkSession.sparkContext.broadcast((kind, data))

    def start():
        count, safe = _counter(*sent.value)

        def work(texts: pa.Array) -> list[pa.Array]:
            sizes = pc.fill_null(pc.binary_length(texts), 0)
            totals = []
            for i, j in spans_of(sizes.to_pylist(), 4 * BATCH_BYTES):
                few = [t or "" for t in texts.slice(i, j - i).to_pylist()]
                if safe and any(len(t) > SECTION_CHARS for t in few):
                    totals += [sum(count([part])[0] for part in sections(t)) for t in few]
                else:
                    totals += count(few)
            made = [sizes.cast(pa.int64()), pa.array(totals, pa.int64())]
            return made if limit is None else [*made, pa.array([n > limit for n in totals], pa.bool_())]

        return work

    fields = [field("n_bytes", "bigint"), field("n_tokens", "bigint")]
    fields += [] if limit is None else [field("over_limit", "boolean")]
    return append(df, {"text": F.col(text)}, fields, start)

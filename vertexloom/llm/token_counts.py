"""Token counts of whole texts: the tokenizer runs inside Arrow functions and only the lengths come back.

With a byte-level tokenizer a text may be cut in front of white space that follows something else: no token goes on
from there into white space, and what stands before the cut has no part in how the rest is read. So a text is a list of
stretches (white space and what follows it up to the next), its count is the sum of theirs, and a stretch that was
counted before needn't be counted again. New stretches go to the library in batches of about equal bytes; one that is
itself longer goes alone. Other tokenizers get whole texts, in batches of equal bytes too.

Null texts count as empty, empty ones have no tokens; each row has its own count, repeated rows too, and a table without rows has none. Only the text is
read: a column function doesn't meet other columns, whatever their names. The strings of special tokens inside a text are read as the library
reads them by default; no begin, end or added tokens, no truncation, no padding.
"""

import os
import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from .buffers import slices

BATCH_BYTES = 64 << 10
#: Stretches that a task remembers, and the longest that it does.
KEPT, KEPT_CHARS = 300_000, 40

# The code points that have the Unicode property White_Space.
WHITE = r"\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_STRETCH = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")


def balanced(texts: list[str], limit: int = BATCH_BYTES):
    """Runs of texts of about `limit` bytes in all; a longer one is alone."""
    batch, size = [], 0
    for text in texts:
        more = len(text) if text.isascii() else len(text.encode())
        if batch and size + more > limit:
            yield batch
            batch, size = [], 0
        batch.append(text)
        size += more
    if batch:
        yield batch


class Counter:
    """Counts with one tokenizer file: .json (tokenizers) or .model (sentencepiece)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.safe = False
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.lengths = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            import json

            from tokenizers import Tokenizer

            tokenizer = Tokenizer.from_file(path)
            tokenizer.no_truncation()
            tokenizer.no_padding()
            self.lengths = lambda texts: [len(x) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            with open(path, encoding="utf-8") as f:
                made = json.load(f)
            before, added = made["pre_tokenizer"] or {}, made["added_tokens"]
            self.safe = (made["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
                         and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(f"[{WHITE}]", t["content"]) for t in added))
        self.known: dict[str, int] = {}

    def batched(self, texts: list[str]) -> list[int]:
        return [n for batch in balanced(texts) for n in self.lengths(batch)]

    def count(self, texts: list[str]) -> list[int]:
        if not self.safe:
            return self.batched(texts)
        if len(self.known) > KEPT:
            self.known = {}
        known, cut = self.known, [_STRETCH.findall(t) for t in texts]
        new = sorted({s for c in cut for s in c if s not in known})
        counts = dict(zip(new, self.batched(new)))
        long = {s: n for s, n in counts.items() if len(s) > KEPT_CHARS}
        known.update(counts)
        out = [sum(map(known.__getitem__, c)) for c in cut]
        for s in long:
            del known[s]
        return out


_loaded: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _loaded:
        _loaded[path] = Counter(path)
    return _loaded[path]


def token_count(text: str | Column, path: str) -> Column:
    """bigint: tokens of each whole text. `path` names the tokenizer's file on every executor."""
    @arrow_udf("bigint")
    def count_tokens(texts: pa.Array) -> pa.Array:
        out: list[int] = []
        for part in slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), "text", 1 << 20):
            out += counter(path).count([t or "" for t in part.column("text").to_pylist()])
        return pa.array(out, pa.int64())

    return count_tokens(text)

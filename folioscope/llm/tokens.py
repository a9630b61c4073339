"""Token counts by a map-side two-tier lookup of pre-token lengths."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import as_text, pieces

#: Code points that str.split() takes for white space and the tokenizer does not.
ODD = re.compile("[" + chr(0x1C) + "-" + chr(0x1F) + "]")
#: The white space that both take for it; splitting there never parts a pre-token.
GAPS = re.compile("[" + "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])) + "]+")
#: Longer pre-tokens are counted but not kept in a cache.
KEEP = 64


def pre_tokens(text: str) -> list[str]:
    """The runs between white space. The tokenizer's own pattern never matches across white space and
    its normalizer works within such runs, so lengths of runs add up to the length of the text."""
    return text.split() if not ODD.search(text) else [x for x in GAPS.split(text) if x]


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pack(lengths: dict[str, int]) -> tuple[bytes, bytes]:
    """A compact table: the pre-tokens, joined by spaces, and their lengths as 32-bit numbers."""
    return " ".join(lengths).encode(), np.array(list(lengths.values()), np.uint32).tobytes()


def unpack(table: tuple[bytes, bytes]) -> dict[str, int]:
    return dict(zip(table[0].decode().split(" ") if table[0] else [], np.frombuffer(table[1], np.uint32).tolist(), strict=True))


class Lengths:
    """Both tiers: the broadcast table, and what it lacks, which is encoded once and kept, up to `most`
    entries."""

    def __init__(self, table: tuple[bytes, bytes], path: str, most: int = 300_000):
        self.first = unpack(table)
        self.known, self.path, self.most, self.tokenizer = dict(self.first), path, most, None

    def encoded(self, words: list[str]) -> dict[str, int]:
        """Lengths of pre-tokens: many are encoded as one text, and offsets tell whose a token is."""
        self.tokenizer = self.tokenizer or load(self.path)
        out: dict[str, int] = {}
        for at in range(0, len(words), 1000):
            part = words[at : at + 1000]
            starts = np.cumsum([0, *(len(w) + 1 for w in part)])
            tokens = np.array([o[0] for o in self.tokenizer.encode(" ".join(part), add_special_tokens=False).offsets], np.int64)
            out.update(zip(part, np.bincount(np.searchsorted(starts, tokens, "right") - 1, minlength=len(part)).tolist(), strict=True))
        return out

    def counts(self, texts: list[str]) -> list[int]:
        """Token counts of texts; the words that neither tier has are encoded together."""
        words = [pre_tokens(t) for t in texts]
        new = self.encoded(list(set().union(*words).difference(self.known)))
        if len(self.known) + len(new) > self.most:
            self.known = dict(self.first)
            new = self.encoded(list(set().union(*words).difference(self.known)))
        self.known.update(new)
        out = [sum(map(self.known.__getitem__, w)) for w in words]
        for w in new:
            if len(w) > KEEP:
                del self.known[w]
        if len(self.known) > self.most:
            self.known = dict(self.first)
        return out


def frequent(tokenizer) -> list[str]:
    """The pre-tokens that the vocabulary has as such: it was made from the most frequent words of a
    large corpus, so it names them, and no pass over the documents is needed to find them. Its size is
    the vocabulary's, whatever the documents are."""
    words = {x.strip() for x in tokenizer.decode_batch([[i] for i in tokenizer.get_vocab().values()])}
    return sorted(w for w in words if w and len(w) <= KEEP and pre_tokens(w) == [w] and chr(0xFFFD) not in w)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit for every row, as the tokenizer file at `path` counts the
    whole text, without begin, end or added special tokens.

    Tier one is a table of the vocabulary's own words and their lengths (bounded by the vocabulary;
    under 1 MB for 50,000 entries) that every worker gets; tier two the worker's cache of what it met
    besides. Which words are in the table changes speed only. One pass, no shuffle. Null and empty texts
    have 0 tokens; long texts are counted whole, in pieces of a batch; rows repeat as they do in docs,
    and an empty table gives an empty one; other columns are not read."""
    tokenizer = load(path)
    words = frequent(tokenizer)
    table = docs.sparkSession.sparkContext.broadcast(pack(dict(zip(words, (len(e.ids) for e in tokenizer.encode_batch(words, add_special_tokens=False)), strict=True))))
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches):
        lengths = Lengths(table.value, path)
        for batch in batches:
            for b in pieces(batch, text_col, 2 << 20):
                texts = as_text(b, text_col)
                n = lengths.counts(texts)
                yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array([len(x.encode()) for x in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)

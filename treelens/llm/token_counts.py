"""Token counts by prefix dynamic programming.

A byte-pair encoding is valid exactly if every two neighbouring tokens are: merging
the pair's bytes gives the pair again. So the encoding of a prefix of a piece is the
encoding of a shorter prefix plus one last token, and it is the only such extension
that is valid. The dynamic program stores, for every prefix of a piece, the last
token and the number of tokens. A text's table holds the exact count of every prefix:
what the library gives for its first n characters alone. Prefixes that end inside a piece have
their piece's own counts on top; white space at the end of a prefix is a piece of its own,
as no word follows it. Questions on truncation or budgets are then answered from the
tables, encoding nothing again.

Defined results: a null or empty text has no tokens; a special token's string in a
text is one token, as in the library; repeated rows are counted row by row; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treelens.llm import pieces as P
from treelens.llm.common import free_name, ship

LIMIT = 512
#: White space of the tokenizers' patterns, and contractions that no shorter prefix is (fixed values).
SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+").finditer
CONTRACTIONS = ("'re", "'ve", "'ll")


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(rest)})
    return table


class PrefixCounter:
    """Token counts of all prefixes under a byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        self.tok, self.specials = P.load(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbol = byte_symbols()
        raw = lambda s: bytes(symbol[c] for c in s)
        special = set(self.specials)
        self.vocab = {raw(s) for s in model["vocab"] if s not in special}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.longest = max(map(len, self.vocab))
        self.symbol = symbol
        self.split = regex.compile(P.BYTE_LEVEL).findall
        self.valid: dict[tuple[bytes, bytes], bool] = {}
        self.known: dict[str, int] = {}

    def _merge(self, data: bytes) -> list[bytes]:
        """Plain byte-pair merging of a few bytes; only pairs of tokens come here."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.rank.get(p, 1 << 60) for p in zip(parts, parts[1:])]
            least = min(ranks)
            if least == 1 << 60:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _pair(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        ok = self.valid.get(key)
        if ok is None:
            if len(self.valid) > P.CACHE_ENTRIES:
                self.valid.clear()
            want = [left, right] if left else [right]
            ok = self.valid[key] = self._merge(left + right) == want
        return ok

    def prefixes(self, data: bytes) -> list[int]:
        """Number of tokens of ``data[:n]`` for n from 0 to its length."""
        counts, last = [0], [b""]
        vocab, valid, pair, longest = self.vocab, self.valid, self._pair, self.longest
        for end in range(1, len(data) + 1):
            for begin in range(max(0, end - longest), end):
                token = data[begin:end]
                if token in vocab:
                    left = last[begin]
                    ok = valid.get((left, token))
                    if ok or ok is None and pair(left, token):
                        counts.append(counts[begin] + 1)
                        last.append(token)
                        break
        return counts

    def count_piece(self, piece: str) -> int:
        n = self.known.get(piece)
        if n is None:
            n = self.prefixes(piece.encode())[-1]
            if len(piece) <= P.LONG_PIECE:  # long ones are rare and would fill the memory
                if len(self.known) > P.CACHE_ENTRIES:
                    self.known.clear()
                self.known[piece] = n
        return n

    def by_character(self, piece: str) -> list[int]:
        """Tokens of the piece's first 1, 2, ... characters."""
        counts = self.prefixes(piece.encode())
        if piece in CONTRACTIONS:  # cut, it is an apostrophe and a word
            return [1 + self.prefixes(piece[1:n].encode())[-1] if n < len(piece) else counts[-1] for n in range(1, len(piece) + 1)]
        if len(counts) == len(piece) + 1:
            return counts[1:]
        ends = accumulate(len(c.encode()) for c in piece)
        return [counts[e] for e in ends]

    def _pieces(self, text: str) -> list[str]:
        if UNUSUAL(text):
            parts = self.tok.pre_tokenizer.pre_tokenize_str(text)
            symbol = self.symbol
            return [bytes(symbol[c] for c in p).decode() for p, _ in parts]
        return self.split(text)

    def pieces(self, text: str) -> list[str]:
        """The text's pieces; a special token's string is a piece of its own."""
        spans = [text]
        for s in self.specials:
            if s in text:
                spans = [x for t in spans for x in (_around(t, s) if t != s else [t])]
        out: list[str] = []
        for t in spans:
            if t in self.specials:
                out.append(t)
            elif t:
                out += self._pieces(t)
        return out

    def table(self, text: str) -> list[int]:
        """Tokens of ``text[:n]`` for n from 0 to its length."""
        counts = [0]
        for piece in self.pieces(text):
            before, at = counts[-1], len(counts) - 1
            if piece in self.specials:  # cut, it is plain text
                counts += [self.count(text[: at + n]) for n in range(1, len(piece))]
                counts.append(before + 1)
            else:
                counts += [before + n for n in self.by_character(piece)]
        for run in SPACES(text):  # at the end of a prefix, white space is one piece
            begin, end = run.span()
            counts[begin + 1 : end + 1] = [counts[begin] + n for n in self.by_character(run.group())]
        return counts

    def count(self, text: str) -> int:
        if "<|" in text:
            ps = self.pieces(text)
            return sum(1 if p in self.specials else self.count_piece(p) for p in ps)
        known = self.known
        ps = self._pieces(text)
        try:
            return sum(map(known.__getitem__, ps))
        except KeyError:
            return sum(map(self.count_piece, ps))

    def at(self, text: str, n: int) -> int:
        """Tokens of the text's first ``n`` characters."""
        return self.table(text)[n]

    def fits(self, text: str, budget: int) -> int:
        """Most characters of a prefix within the budget."""
        counts = self.table(text)
        return max(n for n, c in enumerate(counts) if c <= budget)


@lru_cache(maxsize=4)
def counter_of(path: str) -> PrefixCounter:
    """One counter per Python worker and file, so that tasks share what it learned."""
    return PrefixCounter(path)


def UNUSUAL(text: str) -> bool:
    return P.UNCOMMON.search(text) is not None


def _around(text: str, s: str) -> list[str]:
    parts = text.split(s)
    out = [parts[0]]
    for p in parts[1:]:
        out += [s, p]
    return out


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = counter_of(path)
    for batch in batches:
        texts = batch.column("text")
        counts = [counter.count(t.as_py() or "") for t in texts]
        sizes = [0 if not t.is_valid else t.as_buffer().size for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            ["doc_id", "n_bytes", "n_tokens"],
        )


def _tables(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    counter = counter_of(path)
    for batch in batches:
        for i in range(batch.num_rows):  # a table is as long as its text
            counts = counter.table(batch.column("text")[i].as_py() or "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(i, 1), pa.array([counts], pa.list_(pa.int32()))], ["doc_id", "counts"]
            )


def _narrow(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def count_tokens(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every document."""
    return _narrow(docs, doc_id, text).mapInArrow(
        partial(_count, path=tokenizer), "doc_id long, n_bytes long, n_tokens long"
    )


def prefix_tables(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts): the stored table of every document; ``counts[n]`` is the number of tokens of
    the first n characters."""
    return _narrow(docs, doc_id, text).mapInArrow(partial(_tables, path=tokenizer), "doc_id long, counts array<int>")


def truncation(tables: DataFrame, budget: int) -> DataFrame:
    """``tables`` plus the most characters that fit a budget and their tokens, without encoding anything."""
    fit, tokens = free_name(tables, "fit_chars", "fit_tokens")
    most = F.array_max(F.transform("counts", lambda c, n: F.when(c <= F.lit(budget), n)))
    return tables.withColumn(fit, most).withColumn(tokens, F.get("counts", F.col(fit)))

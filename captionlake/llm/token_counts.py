"""Token counts by the whole-token shortcut (operator 5).

The model's pieces never join characters across the start of a word (no piece has a space mark after another
character, apart from runs of marks), so a text's count is the sum over its units: a run of spaces and what
follows it up to the next space. Once per worker, each vocabulary string is encoded alone; those that come out as
themselves, one token, are whole tokens. Units that are whole tokens are counted by lookup; the library merges
only the distinct others. Counts of units are kept for the rest of a task, at most 400,000 of them, of at most 64
characters each (some 100 MB); longer ones are counted anew in each group of texts.

Nulls: a null text is empty: 0 bytes, 0 tokens. A null doc_id is carried; repeated rows give repeated rows; an
empty table gives none.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean

MARK = "▁"  # the model's sign for a space
UNIT = re.compile(" +[^ ]*")


class PieceCounter:
    MOST, LONGEST = 400_000, 64

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(MARK in p.lstrip(MARK) for p in names):
            raise ValueError("a piece of this vocabulary joins words; units can't be counted alone")
        words = [(i, p[1:]) for i, p in enumerate(names) if p.startswith(MARK) and p.count(MARK) == 1 and len(p) > 1]
        alone = self.model.encode([w for _, w in words], num_threads=1)
        self.whole = {w: 1 for (i, w), ids in zip(words, alone) if ids == [i]}
        self.whole[""] = len(self.model.encode(f"a{MARK}")) - len(self.model.encode("a"))  # a space at the end
        self.forget()

    def forget(self) -> None:
        self.known = dict(self.whole)

    def units(self, text: str) -> list[str]:
        """Units without their first space. The model puts one space before a text that isn't empty."""
        if not text:
            return []
        text = text.replace(MARK, " ")
        if text[0] == " " or "  " in text:
            return [u[1:] for u in UNIT.findall(" " + text)]
        return text.split(" ")

    def count(self, texts: list[str]) -> list[int]:
        units = [self.units(t) for t in texts]
        every = set().union(*units)
        new = every.difference(self.known)
        if len(self.known) + len(new) > self.MOST:
            self.forget()
            new = every.difference(self.known)
        long = {u for u in new if len(u) > self.LONGEST}
        self.known.update(self._merged(new - long))
        get = {**self.known, **self._merged(long)}.__getitem__ if long else self.known.__getitem__
        return [sum(map(get, u)) for u in units]

    def _merged(self, units: set[str]) -> dict[str, int]:
        """The library's counts of units."""
        rest, out = list(units), {}
        for i in range(0, len(rest), 5000):
            part = rest[i : i + 5000]
            out.update(zip(part, map(len, self.model.encode(part, num_threads=1))))
        return out


_counters: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _counters:
        _counters[path] = PieceCounter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row."""

    @lean
    def run(batches):
        import pyarrow as pa

        c = counter(model)
        for b in batches:
            n = []
            for at in range(0, b.num_rows, 200):
                n += c.count(b.column(2).slice(at, 200).to_pylist())
            tokens = pa.array(n, pa.int64())
            over = pa.array([x > limit for x in n], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), tokens, over], names=[id_col, "n_bytes", "n_tokens", "over_limit"])
        c.forget()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")

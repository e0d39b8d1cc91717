"""Vectors from a model behind a call: bounded requests, equal texts once, retries with back-off, failures told by row."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a request is: texts to as many vectors, within so many seconds.
Call = Callable[[list[str], float], list[list[float]]]


@dataclass(frozen=True)
class Remote:
    """``call`` gets ``texts_at_once`` texts at most, of ``chars_at_once`` characters together unless one is longer, and ``timeout``,
    which it must keep. It is called again after a failure, ``retries`` times, each wait twice the one before.

    An answer is wrong if it is empty or has another number of vectors than texts. A request of several texts that
    keeps failing is cut in halves, so one text that the model refuses takes no other with it.
    """

    call: Call
    texts_at_once: int = 32
    chars_at_once: int = 100_000
    timeout: float = 60.0
    retries: int = 3
    wait: float = 0.5

    def _asked(self, texts: list[str]) -> list[list[float]]:
        for k in range(self.retries + 1):
            try:
                vectors = self.call(texts, self.timeout)
                if len(vectors) != len(texts) or not all(len(v) for v in vectors):
                    raise ValueError("the model gave no vector for a text")
                return [list(map(float, v)) for v in vectors]
            except Exception:
                if k == self.retries:
                    raise
                time.sleep(self.wait * 2**k)
        raise AssertionError

    def _answered(self, texts: list[str]) -> list[tuple[list[float] | None, str | None]]:
        try:
            return [(v, None) for v in self._asked(texts)]
        except Exception as e:
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
        half = len(texts) // 2
        return self._answered(texts[:half]) + self._answered(texts[half:])

    def requests(self, texts: list[str]) -> Iterator[list[str]]:
        held, size = [], 0
        for t in texts:
            if held and (len(held) == self.texts_at_once or size + len(t) > self.chars_at_once):
                yield held
                held, size = [], 0
            held.append(t)
            size += len(t)
        if held:
            yield held

    def vectors(self, text: Column) -> Column:
        """Struct of ``vector`` and ``error``, of which one is null, for each text; both are for a null text. Line ends go as blanks.

        A batch of rows is taken together: a text that several of its rows have is sent once.
        """

        @F.arrow_udf("vector array<double>, error string")
        def told(texts: pa.Array) -> pa.Array:
            rows = [None if t is None else t.replace("\n", " ") for t in texts.to_pylist()]
            distinct = list(dict.fromkeys(t for t in rows if t is not None))
            known = dict(zip(distinct, (a for r in self.requests(distinct) for a in self._answered(r)), strict=True)) | {None: (None, None)}
            vectors, errors = zip(*(known[t] for t in rows), strict=True) if rows else ((), ())
            return pa.StructArray.from_arrays([pa.array(list(vectors), pa.list_(pa.float64())), pa.array(list(errors), pa.string())], ["vector", "error"])

        return told(text)

    def __call__(self, text: Column) -> Column:
        """The vector alone, as a service takes it; a text that the model gives none for is an error."""
        return F.transform(F.array(self.vectors(text)), lambda r: F.when(r["error"].isNull(), r["vector"]).otherwise(F.raise_error(r["error"])))[0]

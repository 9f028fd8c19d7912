"""Fill-in-the-middle texts over seekable compressed frames.

A text is stored as independent zstandard frames of ``FRAME_UNITS`` code points,
each with the number of units up to its end. To cut it in three, only the frames
that hold a cut are decompressed; all others are handed on as they are, in their
new order. Digests and the way back read the frames of a text in order, one at a
time. Every row stands alone, so nothing is shuffled.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from askloom.llm.common import mapped, texts

#: Code points of a whole frame.
FRAME_UNITS = 16_384
#: Marks before the three parts (fixed values), and the orders in which forms write them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
ORDERS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Percentages of texts that stay plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20

#: A frame: units up to and with it, and its bytes.
_FRAMES = "array<struct<until:bigint,frame:binary>>"


class Frames:
    """A text as frames, in order."""

    def __init__(self, frames: Iterable[tuple[int, bytes]] = ()):
        self.until: list[int] = []
        self.data: list[bytes] = []
        for until, data in frames:
            self.until.append(until)
            self.data.append(data)

    @classmethod
    def of(cls, text: str, units: int = FRAME_UNITS) -> Frames:
        made = cls()
        for a in range(0, len(text), units):
            made.add(text[a : a + units])
        return made

    def __len__(self) -> int:
        """Code points of the text."""
        return self.until[-1] if self.until else 0

    def rows(self) -> list[dict]:
        return [{"until": u, "frame": d} for u, d in zip(self.until, self.data)]

    def add(self, text: str) -> None:
        if text:
            self.add_frame(len(text), zstandard.ZstdCompressor(level=1).compress(text.encode()))

    def add_frame(self, units: int, data: bytes) -> None:
        self.until.append(len(self) + units)
        self.data.append(data)

    def start(self, i: int) -> int:
        return self.until[i - 1] if i else 0

    def text(self, i: int) -> str:
        return self.bytes(i).decode()

    def bytes(self, i: int) -> bytes:
        return zstandard.ZstdDecompressor().decompress(self.data[i])

    def copy(self, into: Frames, a: int, b: int) -> None:
        """Units ``a`` to ``b`` to the end of ``into``. Only the frames that one of
        the two cuts through are decompressed."""
        i = bisect_left(self.until, a + 1)
        while i < len(self.until) and self.start(i) < b:
            low, high = max(a, self.start(i)), min(b, self.until[i])
            if (low, high) == (self.start(i), self.until[i]):
                into.add_frame(high - low, self.data[i])
            else:
                into.add(self.text(i)[low - self.start(i) : high - self.start(i)])
            i += 1

    def stream(self) -> Iterator[bytes]:
        for i in range(len(self.data)):
            yield self.bytes(i)

    def sha256(self) -> str:
        digest = hashlib.sha256()
        for part in self.stream():
            digest.update(part)
        return digest.hexdigest()

    def find(self, marks: Iterable[str]) -> dict[str, int]:
        """First place of each of the marks that occur, reading frame by frame with
        an overlap of one mark."""
        left, found, tail, at = list(marks), {}, "", 0
        for i in range(len(self.data)):
            if not left:
                break
            held = tail + self.text(i)
            for mark in list(left):
                if (k := held.find(mark)) >= 0:
                    found[mark] = at + k
                    left.remove(mark)
            keep = min(len(held), len(PREFIX) - 1)
            at += len(held) - keep
            tail = held[len(held) - keep :]
        return found


def draws(doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 from the id (a null one counts as no digits)."""
    hexes = hashlib.sha256(b"1:" + (b"" if doc_id is None else b"%d" % doc_id)).hexdigest()
    return [int(hexes[k : k + 8], 16) for k in range(0, 32, 8)]


def choose(doc_id: int | None, frames: Frames) -> tuple[str, int, int]:
    """``form, first cut, second cut`` of a text."""
    h, n = draws(doc_id), len(frames)
    if not n or h[2] % 100 >= 100 - PLAIN or frames.find((PREFIX, SUFFIX, MIDDLE)):
        return "plain", 0, 0
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return ("spm" if h[3] % 100 < SUFFIX_FIRST else "psm"), a, b


def rearrange(frames: Frames, form: str, a: int, b: int) -> Frames:
    """The frames of the output. Whole frames are passed on unchanged."""
    if form == "plain":
        return frames
    part = {PREFIX: (0, a), MIDDLE: (a, b), SUFFIX: (b, len(frames))}
    made = Frames()
    for mark in ORDERS[form]:
        made.add(mark)
        frames.copy(made, *part[mark])
    return made


def restore(output: Frames, form: str) -> Frames:
    """The text from its output and form alone."""
    if form == "plain":
        return output
    order = ORDERS[form]
    at = output.find(order)
    ends = dict(zip(order, [*(at[m] for m in order[1:]), len(output)]))
    made = Frames()
    for mark in (PREFIX, MIDDLE, SUFFIX):
        output.copy(made, at[mark] + len(mark), ends[mark])
    return made


def _frames_of(column) -> Iterator[Frames]:
    for rows in column.to_pylist():
        yield Frames((r["until"], r["frame"]) for r in rows or ())


def store(docs: DataFrame, units: int = FRAME_UNITS) -> DataFrame:
    """``doc_id, frames``: every whole text as frames. Null and empty texts have
    none. One row per row, also where ids are null or repeat; other columns go."""

    def work(batch):
        return {
            "doc_id": batch.column("doc_id"),
            "frames": [Frames.of(t, units).rows() for t in batch.column("text").to_pylist()],
        }

    return mapped(texts(docs), work, f"doc_id long, frames {_FRAMES}")


def fill_in_middle(stored: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` from ``doc_id, frames``;
    ``output`` is frames again.

    A text is cut at two places drawn from the hash of its id, in code points.
    It stays plain if it is empty, holds one of the marks, or by lot; then the
    lengths are null. A null id draws as one without digits. Equal rows give
    equal results.
    """

    def work(batch):
        rows = []
        ids = batch.column("doc_id").to_pylist()
        for doc_id, frames in zip(ids, _frames_of(batch.column("frames"))):
            form, a, b = choose(doc_id, frames)
            cut = form != "plain"
            rows.append(
                (len(frames), form, a if cut else None, b - a if cut else None,
                 rearrange(frames, form, a, b).rows())
            )
        names = ("n", "form", "prefix_chars", "middle_chars", "output")
        return {"doc_id": batch.column("doc_id")} | {n: [r[k] for r in rows] for k, n in enumerate(names)}

    return mapped(
        stored.select(F.col("doc_id").cast("long").alias("doc_id"), "frames"), work,
        f"doc_id long, n long, form string, prefix_chars long, middle_chars long, output {_FRAMES}",
    )


def as_text(framed: DataFrame, column: str = "output") -> DataFrame:
    """Frames in ``column`` read as a string in its place."""
    types = {name: kind for name, kind in framed.dtypes if name != column}

    def work(batch):
        made = {name: batch.column(name) for name in types}
        return made | {column: [b"".join(f.stream()).decode() for f in _frames_of(batch.column(column))]}

    ddl = ", ".join(f"`{name}` {kind}" for name, kind in types.items())
    return mapped(framed, work, f"{ddl}, `{column}` string")


def restored(made: DataFrame) -> DataFrame:
    """``doc_id, frames`` of the texts, from ``doc_id, form, output`` alone."""

    def work(batch):
        forms = batch.column("form").to_pylist()
        back = [restore(o, f).rows() for o, f in zip(_frames_of(batch.column("output")), forms)]
        return {"doc_id": batch.column("doc_id"), "frames": back}

    return mapped(made.select("doc_id", "form", "output"), work, f"doc_id long, frames {_FRAMES}")


def digests(made: DataFrame) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``
    of what ``fill_in_middle`` gives; the restored text is rebuilt from the output."""
    kept = ("doc_id", "n", "form", "prefix_chars", "middle_chars")

    def work(batch):
        forms = batch.column("form").to_pylist()
        hashes = [(o.sha256(), restore(o, f).sha256()) for o, f in zip(_frames_of(batch.column("output")), forms)]
        return {name: batch.column(name) for name in kept} | {
            "output_sha256": [h[0] for h in hashes], "restored_sha256": [h[1] for h in hashes],
        }

    return mapped(
        made.select(*kept, "output"), work,
        "doc_id long, n long, form string, prefix_chars long, middle_chars long, "
        "output_sha256 string, restored_sha256 string",
    )


SQL = """
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), cuts AS (
  SELECT doc_id, t, n, ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
                   OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), parts AS (
  SELECT *, least(c1, c2) AS a, greatest(c1, c2) AS b, substring(t, 1, least(c1, c2)) AS p,
         substring(t, least(c1, c2) + 1, greatest(c1, c2) - least(c1, c2)) AS m,
         substring(t, greatest(c1, c2) + 1) AS s
  FROM cuts
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                        ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts
"""

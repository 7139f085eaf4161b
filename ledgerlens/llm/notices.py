"""Fuzzy search for short licence notices.

A text becomes its words joined by single blanks. A notice is cut into k+2
pieces; a place where it stands with at most k edits keeps two of them whole,
k characters apart from where they belong at most. An Aho-Corasick automaton
over the pieces finds such places; the ``regex`` library then matches the
notice there with a bounded number of edits and gives the span. The words that
tell one licence from another must stand unedited.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import kernels
from ledgerlens.llm.common import arrow_job, table

#: Exact phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Notices that are searched with edits, in normalised words; those in braces must stand as they are (fixed values).
NOTICES = {
    "apache": "licensed under the {apache} license version",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "bsd-license": "released under the {bsd} license",
    "cc": "licensed under the {creative commons} attribution",
    "cc-by-nc": "licensed under {cc by nc}",
    "cc-by-sa": "licensed under {cc by sa}",
    "gpl-notice": "licensed under the {gnu general public} license version",
    "mit": "released under the {mit} license",
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy",
    "mpl": "subject to the terms of the {mozilla public} license",
    "rights": "all rights reserved",
}
#: One edit for so many characters of a notice.
CHARACTERS_PER_EDIT = 10
#: Separators become blanks and A-Z lower case; the bytes of other characters stay.
_NORMAL = bytes(int(kernels.LOWER[b]) if kernels.IS_WORD[b] else 32 for b in range(256))


def edits_of(notice: str) -> int:
    return max(1, len(notice) // CHARACTERS_PER_EDIT)


def pieces(notice: str, k: int) -> list[tuple[int, str]]:
    """k+2 pieces of nearly equal length and their offsets: k edits leave two of them whole."""
    cuts = [len(notice) * i // (k + 2) for i in range(k + 3)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@dataclass(frozen=True)
class Notice:
    text: str
    edits: int
    #: The exact words with a blank at either end; all of them stand in a match.
    exact: tuple[str, ...]
    pattern: object

    @staticmethod
    def of(marked: str) -> Notice:
        import regex

        text = marked.replace("{", "").replace("}", "")
        k = edits_of(text)
        parts = [p for p in re.split(r" ?(\{[^}]*\}) ?", marked) if p]
        exact = tuple(f" {p[1:-1]} " for p in parts if p[0] == "{")
        pattern = "".join(regex.escape(f" {p[1:-1]} ", literal_spaces=True) if p[0] == "{" else f"(?:{regex.escape(p, literal_spaces=True)}){{e<={k}}}" for p in parts)
        return Notice(text, k, exact, regex.compile(f"(?b){pattern}"))


@dataclass(frozen=True)
class Hit:
    label: str
    start: int
    end: int
    edits: int
    similarity: float


class Finder:
    """Finds notices in normalised text."""

    def __init__(self, notices: dict[str, str] = NOTICES):
        import ahocorasick

        self.notices = {label: Notice.of(marked) for label, marked in notices.items()}
        seeds: dict[str, list[tuple[str, int, int]]] = {}
        for label, notice in self.notices.items():
            for number, (at, piece) in enumerate(pieces(notice.text, notice.edits)):
                seeds.setdefault(piece, []).append((label, number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def windows(self, text: str) -> dict[str, list[tuple[int, int]]]:
        """For each notice the bounded stretches in which two of its pieces lie where they belong, in order."""
        cells: dict[str, dict[int, set[int]]] = {}
        for last, (size, owners) in self.automaton.iter(text):
            for label, number, at in owners:
                # Starts that k edits can bring together lie in the same or in neighbouring cells.
                cells.setdefault(label, {}).setdefault((last - size + 1 - at) // (self.notices[label].edits + 1), set()).add(number)
        found = {}
        for label, of_cell in cells.items():
            notice = self.notices[label]
            width = notice.edits + 1
            places = sorted(c for c in {c - d for c in of_cell for d in (0, 1)} if len(of_cell.get(c, set()) | of_cell.get(c + 1, set())) > 1)
            if places:
                found[label] = [(max(0, c * width - notice.edits), (c + 2) * width + len(notice.text) + 2 * notice.edits) for c in places]
        return found

    def find(self, text: str) -> list[Hit]:
        """The verified notices with their spans; of one notice, spans that overlap give way to the one of fewest edits."""
        hits = []
        for label, spans in self.windows(text).items():
            notice, best = self.notices[label], []
            for start, end in spans:
                if not all(text.find(word, start, end) >= 0 for word in notice.exact):
                    continue
                m = notice.pattern.search(text, start, min(len(text), end))
                if m is None or (edits := sum(m.fuzzy_counts)) > notice.edits:
                    continue
                hit = Hit(label, m.start(), m.end(), edits, 1 - edits / len(notice.text))
                if best and hit.start < best[-1].end:
                    if hit.edits < best[-1].edits:
                        best[-1] = hit
                else:
                    best.append(hit)
            hits += best
        return hits


def normalise(data: bytes) -> list[bytes]:
    """The lower-cased words of a text."""
    return data.translate(_NORMAL).split()


_finder: list[Finder] = []


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if not _finder:
        _finder.append(Finder())
    finder = _finder[0]
    phrases = {f" {p} ".encode(): label for p, label in BASE.items()}
    for batch in batches:
        raw, at = kernels.utf8(batch["text"])
        rows = []
        for i in range(batch.num_rows):
            words = normalise(raw[at[i] : at[i + 1]].tobytes())
            joined = b" ".join([b"", *words, b""])
            starts, labels = [], set()
            for phrase, label in phrases.items():
                p = joined.find(phrase)
                while p >= 0:
                    starts.append(p)
                    labels.add(label)
                    p = joined.find(phrase, p + 1)
            hits = finder.find(joined.decode("utf-8", "replace"))
            # The blank at p stands before word number (blanks up to it).
            first = joined.count(b" ", 0, min(starts)) if starts else None
            last = joined.count(b" ", 0, max(starts)) if starts else None
            score = 1.0 if starts else max((h.similarity for h in hits), default=0.0)
            every = sorted(labels | {h.label for h in hits})
            rows.append([len(words), len(starts), first, last, ",".join(sorted(labels)), ",".join(every), score, [{"label": h.label, "start": h.start, "end": h.end, "edits": h.edits} for h in hits]])
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("edits", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], ["doc_id", *names])


def scan(docs: DataFrame) -> DataFrame:
    """One row per document row: words, exact phrases, labels, score and the spans of notices.

    The score is 1 where a base phrase stands, else the best notice's share of
    unedited characters, else 0. Spans are offsets in characters of the words
    joined by blanks, with a blank at either end; of one notice they don't
    overlap. Edits are counted in characters. Null texts are empty: no words,
    no labels, no spans. Repeated rows each keep a row; a null id stays null;
    other columns are left out.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start: int, end: int, edits: int>>"
    return arrow_job(docs.select("doc_id", "text"), _scan, schema)


def op9_fuzzy_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))

"""License scans: fuzzy search for short notices.

A notice that may hold k edits is cut into k + 1 seeds; by the pigeonhole
principle every match keeps one seed whole.  One automaton finds all seeds of
all notices in the word-normalised text, each hit names the window in which
the notice must lie, and the regex library's bounded-error matching verifies
the window and reports span and edits.  Base phrases are notices without
edits, whose one seed is the whole phrase.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weirflow.llm._shared import table


@dataclass(frozen=True)
class Notice:
    text: str
    label: str
    edits: int


#: Base phrases: every place counts.
BASE = (
    Notice("cc by", "cc-by", 0),
    Notice("general public license", "gpl", 0),
    Notice("all rights reserved", "reserved", 0),
)
#: Notices of this operator's own, in normalised words, with the edits that each may hold.
OWN = (
    Notice("licensed under the apache license version 2 0", "apache", 4),
    Notice("you may not use this file except in compliance with the license", "apache", 6),
    Notice("released under the mit license", "mit", 3),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 7),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd", 7),
    Notice("this program is free software you can redistribute it and or modify it", "gpl-notice", 7),
    Notice("licensed under the gnu general public license", "gpl-notice", 4),
    Notice("licensed under the mozilla public license", "mpl", 4),
    Notice("creative commons attribution", "cc-attribution", 2),
    Notice("licensed under cc by", "cc-notice", 1),
    Notice("the software is provided as is without warranty of any kind", "as-is", 6),
    Notice("all rights reserved", "reserved-near", 2),
    Notice("general public license", "gpl-near", 2),
)

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass
class Hit:
    notice: Notice
    first_word: int
    last_word: int
    edits: int
    first_char: int
    last_char: int


class Scanner:
    """Finds notices in texts; one is made in each Python worker."""

    def __init__(self, notices: tuple[Notice, ...]) -> None:
        self.seeds = ahocorasick.Automaton()
        self.notices = notices
        found: dict[str, list[tuple[int, int, int]]] = {}
        self.patterns = []
        for k, n in enumerate(notices):
            body = f" {n.text} " if not n.edits else n.text
            parts = n.edits + 1
            cuts = [len(body) * i // parts for i in range(parts + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                found.setdefault(body[a:b], []).append((k, a, len(body)))
            self.patterns.append(regex.compile(rf"(?e)(?<![^ ])(?:{regex.escape(n.text)}){{e<={n.edits}}}(?![^ ])"))
        for seed, where in found.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def scan(self, text: str) -> tuple[list[str], list[Hit]]:
        """Words of the text, and the hits of each notice in order, without overlaps for notices with edits."""
        words = WORD.findall((text or "").translate(LOWER))
        line = f" {' '.join(words)} "
        windows: dict[int, list[list[int]]] = {}
        for end, (length, where) in self.seeds.iter(line):
            for k, at, size in where:
                e = self.notices[k].edits
                start = end + 1 - length - at
                lo, hi = max(0, start - e), min(len(line), start + size + e)
                held = windows.setdefault(k, [])
                if held and e and lo <= held[-1][1]:
                    held[-1][1] = max(held[-1][1], hi)
                    held[-1][0] = min(held[-1][0], lo)
                else:
                    held.append([lo, hi])
        out = []
        # Where each word starts in the line, so that a place is found without counting from the start.
        starts = list(accumulate((len(w) + 1 for w in words), initial=1)) if windows else []
        for k, held in windows.items():
            notice = self.notices[k]
            for lo, hi in held:
                for m in self.patterns[k].finditer(line, max(0, lo - 1), min(len(line), hi + 1)):
                    a, b = m.span()
                    first = bisect_right(starts, a + (line[a] == " ")) - 1
                    out.append(Hit(notice, first, first + m.group().strip().count(" "), sum(m.fuzzy_counts), a, b))
        return words, out


def scan(docs: DataFrame, base: tuple[Notice, ...] = BASE, own: tuple[Notice, ...] = OWN) -> DataFrame:
    """(doc_id, n_words, hits): the notices found in each whole text, null as empty.

    A hit has label, base, edits, first_word, last_word (from 0), and matched.
    Hits of one notice don't overlap, but for base phrases, of which every
    place counts.  Every row of docs gives a row, repeated ones and those with a
    null doc_id too; an empty table gives none, and other columns are left out.
    Of equally close matches the regex library's first is taken.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, n_base = Scanner(base + own), len(base)
        kind = pa.list_(
            pa.struct([("label", pa.string()), ("base", pa.bool_()), ("edits", pa.int32()), ("size", pa.int32()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("matched", pa.string())])
        )
        bases = set(scanner.notices[:n_base])
        for batch in batches:
            counts, hits = [], []
            for t in batch.column("text"):
                words, got = scanner.scan(t.as_py())
                counts.append(len(words))
                hits.append(
                    [
                        {"label": h.notice.label, "base": h.notice in bases, "edits": h.edits, "size": len(h.notice.text), "first_word": h.first_word, "last_word": h.last_word, "matched": " ".join(words[h.first_word : h.last_word + 1])}
                        for h in got
                    ]
                )
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hits, kind)], ["doc_id", "n_words", "hits"])

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    hit = "struct<label:string,base:boolean,edits:int,size:int,first_word:long,last_word:long,matched:string>"
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words long, hits array<{hit}>")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document: words, places of base phrases with the first and last start, labels, and the closest match from 0 to 1.

    A null or empty text has no words, no labels and score 0.
    """
    found = scan(table(spark, sf_dir, "documents"))
    base = F.filter("hits", lambda h: h["base"])
    labels = lambda hits: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))))
    closeness = F.transform("hits", lambda h: 1 - h["edits"] / h["size"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["first_word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["first_word"])).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("hits")).alias("labels"),
        F.coalesce(F.array_max(closeness), F.lit(0.0)).cast("double").alias("score"),
        F.size("hits").alias("n_hits"),
    )

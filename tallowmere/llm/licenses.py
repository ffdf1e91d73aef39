"""License scans: notices in template markup, compiled into automata over words.

``[[...]]`` is optional, ``{{name:least-most}}`` stands for that many words of any kind, and all other
words are mandatory: a text is accepted if these match exactly and in order.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, text_of

#: Phrases and the labels that they give wherever their words stand consecutively.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Wordings of public license notices in template markup.
TEMPLATES = (
    ("mit", "[[this {{work:1-3}} is]] released under the mit license"),
    ("mit", "[[this {{work:1-3}} is]] licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2.0", "licensed under the apache license version 2 0 [[the license]]"),
    ("gpl-3.0", "[[this {{work:1-3}} is]] licensed under the gnu general public license version 3 [[or any later version]]"),
    ("gpl-3.0", "[[it]] under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "[[this {{work:1-3}} is]] licensed under the gnu general public license version 2 [[or any later version]]"),
    ("cc-by-nc-4.0", "licensed under [[a]] [[creative commons]] cc by nc 4 0 [[international]] [[license]]"),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa-4.0", "licensed under [[a]] [[creative commons]] cc by sa 4 0 [[international]] [[license]]"),
    ("cc-by-4.0", "licensed under [[a]] [[creative commons]] cc by 4 0 [[international]] [[license]]"),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("copyright", "copyright {{year and holder:1-8}} all rights reserved"),
)
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_MARK = re.compile(r"(\[\[|\]\]|\{\{[^}]*\}\})")


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z are lower-cased) and all characters beyond ASCII, in UTF-8."""
    return WORD.findall(text.lower())


@dataclass
class Automaton:
    """States 0 to ``end``; ``steps[s]`` has (word or None for any word, next state), ``skips[s]`` states reached by nothing."""

    label: str
    steps: list[list[tuple[bytes | None, int]]]
    skips: list[list[int]]
    anchor: bytes
    before: int
    longest: int

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        steps, skips, opened = [[]], [[]], []
        run: list[bytes] = []
        runs: list[tuple[list[bytes], int]] = []
        most = 0  # words that the part so far can take
        at_run = 0

        def state() -> int:
            steps.append([])
            skips.append([])
            return len(steps) - 1

        def close() -> None:
            if run:
                runs.append((run.copy(), at_run))
                run.clear()

        for part in _MARK.split(template):
            if part == "[[":
                close()
                opened.append(len(steps) - 1)
            elif part == "]]":
                skips[opened.pop()].append(len(steps) - 1)
            elif part.startswith("{{"):
                close()
                _, _, span = part[2:-2].partition(":")
                low, _, high = span.partition("-")
                low, high = int(low or 1), int(high or low or 1)
                doors = []
                for k in range(high):
                    here = len(steps) - 1
                    if k >= low:
                        doors.append(here)
                    steps[here].append((None, state()))
                for d in doors:
                    skips[d].append(len(steps) - 1)
                most += high
            else:
                for w in words_of(part.encode()):
                    here = len(steps) - 1
                    steps[here].append((w, state()))
                    if not opened:
                        if not run:
                            at_run = most
                        run.append(w)
                    most += 1
        close()
        anchor, before = max(runs, key=lambda r: sum(map(len, r[0])))
        return cls(label, steps, skips, b" " + b" ".join(anchor) + b" ", before, most)

    def _closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for s in self.skips[todo.pop()]:
                if s not in seen:
                    seen.add(s)
                    todo.append(s)
        return seen

    def accepted(self, words: list[bytes], start: int) -> int:
        """Where the longest accepted run of words from ``start`` ends; -1 if none is."""
        now, end, final = self._closure({0}), -1, len(self.steps) - 1
        for i in range(start, len(words) + 1):
            if final in now:
                end = i
            if i == len(words) or not now:
                break
            now = self._closure({t for s in now for w, t in self.steps[s] if w is None or w == words[i]})
        return end

    def spans(self, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
        """Accepted runs (first word, word after the last), one for each place of the longest mandatory wording: from the earliest start."""
        out = []
        for place in places(joined, self.anchor):
            for start in range(max(0, place - self.before), place + 1):
                if (end := self.accepted(words, start)) > place:
                    out.append((start, end))
                    break
        return out


def automata(templates=TEMPLATES) -> list[Automaton]:
    return [Automaton.compile(*t) for t in templates]


def pattern(template: str) -> str:
    """The template as a regular expression over words with a blank around each, for SQL."""
    out = []
    for part in _MARK.split(template):
        if part == "[[":
            out.append("(?:")
        elif part == "]]":
            out.append(")?")
        elif part.startswith("{{"):
            out.append("(?:[^ ]+ ){" + part[2:-2].partition(":")[2].replace("-", ",") + "}")
        else:
            out += [w.decode() + " " for w in words_of(part.encode())]
    return " " + "".join(out)


def sql_values(templates=TEMPLATES) -> str:
    return ", ".join(f"('{label}', '{pattern(t)}')" for label, t in templates)


def places(joined: bytes, sought: bytes) -> list[int]:
    """Every word at which the words of ``sought`` stand consecutively, overlapping places too; both have a blank around each word.

    Words are counted from one place to the next, so a text is walked once however many places it has.
    """
    out, at, before, word = [], joined.find(sought), 0, 0
    while at >= 0:
        word += joined.count(b" ", before, at)
        before = at
        out.append(word)
        at = joined.find(sought, at + 1)
    return out


def scan(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), base=BASE, templates=TEMPLATES) -> DataFrame:
    """``carry`` columns and what each whole text says of its license.

    n_words; base_places (struct of label and first word of every place of a base phrase); matches (struct
    of label, first word and the word after the last of every accepted template).  Null counts as empty.
    Rows stay as many as they are.
    """
    small_batches(docs.sparkSession)
    kept = docs.select(*carry, text_of().cast("binary").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    schema += ", n_words bigint, base_places array<struct<label:string,word:bigint>>, matches array<struct<label:string,start:bigint,end:bigint>>"
    place, match = pa.struct([("label", pa.string()), ("word", pa.int64())]), pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        machines = automata(templates)
        phrases = [(b" " + phrase.encode() + b" ", label) for phrase, label in base]
        for b in batches:
            n, found, matched = [], [], []
            for text in b.column(len(carry)).to_pylist():
                words = words_of(text)
                joined = b" " + b" ".join(words) + b" "
                n.append(len(words))
                found.append([{"label": label, "word": w} for phrase, label in phrases for w in places(joined, phrase)])
                matched.append([{"label": m.label, "start": s, "end": e} for m in machines for s, e in m.spans(words, joined)])
            yield pa.RecordBatch.from_arrays([*b.columns[: len(carry)], pa.array(n, pa.int64()), pa.array(found, pa.list_(place)), pa.array(matched, pa.list_(match))], [*carry, "n_words", "base_places", "matches"])

    return kept.mapInArrow(run, schema)


def license_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``score`` is 1 if a template is accepted, else one half if a base phrase stands somewhere, else 0.
    Words are counted from 0; without a place first_word and last_word are null and the labels empty.
    """
    s = scan(docs)
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    base, own = F.col("base_places.label"), F.col("matches.label")
    return s.select(
        "doc_id",
        "n_words",
        F.size("base_places").cast("long").alias("n_base"),
        F.array_min("base_places.word").alias("first_word"),
        F.array_max("base_places.word").alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, own)).alias("labels"),
        F.when(F.size("matches") > 0, 1.0).when(F.size("base_places") > 0, 0.5).otherwise(0.0).alias("score"),
    )

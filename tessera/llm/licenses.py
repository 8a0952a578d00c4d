"""License scan by template markup.

A template is a text with optional regions ``[[ ... ]]`` and replaceable ones ``{{n}}`` (up to n words of anything).
It is compiled to an automaton over tokens; a text holds it where all mandatory words stand as written. Fixed phrases are
found beside it.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import doc_frame, per_row
from .license_templates import TEMPLATES

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 32 for c in (x + 32 if 65 <= x <= 90 else x for x in range(256)))
_PHRASES = [(p.encode().split(), label) for p, label in PHRASES.items()]


def markup(template: str) -> list[str]:
    """``[[``, ``]]``, ``{{n}}`` and words, as texts are split into words."""
    out: list[str] = []
    for mark, text in re.findall(r"(\[\[|\]\]|\{\{\d+\}\})|([^\[\]{}]+)", template):
        out += [mark] if mark else text.encode().translate(_WORD).decode().split()
    return out


class Automaton:
    """States are token positions; a state has (word, next) edges, (wildcard, next) edges and free edges."""

    def __init__(self, template: str) -> None:
        self.words: list[tuple[int, bytes, int]] = []
        self.free: list[tuple[int, int]] = []
        self.n = 1
        opened: list[int] = []
        at = 0
        for token in markup(template):
            if token == "[[":
                opened.append(at)
            elif token == "]]":
                self.free.append((opened.pop(), at))
            elif token.startswith("{{"):
                first = at
                for _ in range(int(token[2:-2])):
                    self.words.append((at, b"", self.n))
                    at, self.n = self.n, self.n + 1
                self.free += [(s, at) for s in (first, *range(first + 1, at)) if s != at]
            else:
                self.words.append((at, token.encode(), self.n))
                at, self.n = self.n, self.n + 1
        self.final = at
        closure = [{s} for s in range(self.n)]
        for s in range(self.n - 1, -1, -1):  # free edges go forward
            for a, b in self.free:
                if a == s:
                    closure[s] |= closure[b]
        self.step: list[dict[bytes, set[int]]] = [{} for _ in range(self.n)]
        for s in range(self.n):
            for a, word, b in self.words:
                if a in closure[s]:
                    self.step[s].setdefault(word, set()).update(closure[b])
        self.start = closure[0]
        self.first = {w for s in self.start for w in self.step[s]}

    def match(self, words: list[bytes], i: int) -> tuple[int | None, float]:
        """(end of the longest match from word i or None, share of the template's states gone through)."""
        states, end, far = self.start, None, 0
        for j in range(i, len(words)):
            then: set[int] = set()
            for s in states:
                edges = self.step[s]
                then |= edges.get(words[j], set()) | edges.get(b"", set())
            if not then:
                break
            states, far = then, max(far, *then)
            if self.final in states:
                end = j + 1
        return end, 1.0 if end is not None else min(0.99, far / max(1, self.final))


@lru_cache(maxsize=1)
def _starts() -> tuple[dict[bytes, list[tuple[list[bytes], str]]], dict[bytes, list[tuple[str, Automaton]]]]:
    """Phrases, and templates, by each word that they may begin with."""
    phrases: dict[bytes, list[tuple[list[bytes], str]]] = {}
    for words, label in _PHRASES:
        phrases.setdefault(words[0], []).append((words, label))
    templates: dict[bytes, list[tuple[str, Automaton]]] = {}
    for label, template in TEMPLATES.items():
        machine = Automaton(template)
        if b"" in machine.first or machine.final in machine.start:
            raise ValueError(f"template {label} must begin with a word")
        for word in machine.first:
            templates.setdefault(word, []).append((label, machine))
    return phrases, templates


def scan_license(text: bytes) -> tuple[int, list[tuple[str, int]], list[tuple[str, int, int]], float]:
    """(words, phrases with the word each starts at, template matches (label, first word, end), best score).

    Words are gone through once; from each word that a template may begin with, its automaton runs no further than the
    template is long. Matches of one template do not overlap.
    """
    words = text.translate(_WORD).split()
    phrases, templates = _starts()
    if templates.keys().isdisjoint(words) and phrases.keys().isdisjoint(words):
        return len(words), [], [], 0.0
    places: list[tuple[str, int]] = []
    found: list[tuple[str, int, int]] = []
    taken: dict[str, int] = {}
    score = 0.0
    for i, w in enumerate(words):
        for phrase, label in phrases.get(w, ()):
            if words[i : i + len(phrase)] == phrase:
                places.append((label, i))
        for label, machine in templates.get(w, ()):
            if i >= taken.get(label, 0):
                end, part = machine.match(words, i)
                score = max(score, part if part >= 0.5 else 0.0)
                if end is not None:
                    found.append((label, i, end))
                    taken[label] = end
    return len(words), places, found, 1.0 if places else score


def _row(doc_id, text):
    n, places, found, score = scan_license(text)
    return doc_id, n, [{"label": a, "word": b} for a, b in places], [{"label": a, "word": b, "end": c} for a, b, c in found], float(score)


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, places, templates, score) for every row; repeated rows give repeated results, an empty table none.

    places: fixed phrases as (label, word); templates: matches as (label, word, end). score is 1 for a phrase or a full
    match, the share of the template passed for a partial one of at least half, else 0. Null and empty texts: 0 words.
    """
    return per_row(doc_frame(docs, id_col, text_col), _row, "doc_id long, n_words long, places array<struct<label:string,word:long>>, templates array<struct<label:string,word:long,end:long>>, score double")

"""Licence scan: an Aho-Corasick automaton finds notices and identifier tags, a shunting-yard parser reads expressions.

``scan`` reads each whole text once. Words are runs of ASCII letters, digits and all other non-ASCII characters; only
A-Z are lower-cased. The automaton holds every notice phrase, bounded by word ends. Where the words of an identifier
tag occur, the rest of its line is parsed as an expression (and, or, with, parentheses). Neighbouring notices parted by
"or"/"and" form an expression too; separate statements are joined by "and".

Defined cases: a null or empty text has no words, no labels, null places and score 0; a malformed expression adds no
label and is returned in ``malformed``; repeated rows each get their row; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import ALNUM_WORDS, map_batches, text_bytes

# Phrases and labels that must be reported.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices of public licences.
NOTICES = {
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "isc license": "isc",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-expression:")
# Burden of a label: 1 permissive, 2 weak copyleft, 3 strong copyleft, 4 use is restricted.
BURDEN = {"mit": 1, "apache": 1, "bsd": 1, "isc": 1, "cc0": 1, "cc-by": 1, "lgpl": 2, "mpl": 2, "epl": 2, "cc-by-sa": 3,
          "gpl": 3, "agpl": 3, "cc-by-nc": 4, "cc-by-nd": 4, "proprietary": 4}
WEIGHT = {"tag": 0.95, "base": 0.6, "notice": 0.5}

SCHEMA = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "expressions array<string>, malformed array<string>, burden int")

_PRECEDENCE = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:_-]+")
_TAG_TOKEN = re.compile(r"[()/]|[A-Za-z0-9.+:_-]+")


def to_postfix(expression: str | list[str]) -> list[str] | None:
    """Postfix order of a licence expression (shunting-yard); None if it is malformed."""
    tokens = expression if isinstance(expression, list) else _TOKEN.findall(expression)
    out, stack, operand_due = [], [], True
    for token in tokens:
        word = token.lower()
        if word == "(":
            if not operand_due:
                return None
            stack.append(word)
        elif word == ")":
            if operand_due:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        elif word in _PRECEDENCE:
            if operand_due:
                return None
            while stack and _PRECEDENCE.get(stack[-1], 0) >= _PRECEDENCE[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_due = True
        else:
            if not operand_due:
                return None
            out.append(word)
            operand_due = False
    if operand_due or "(" in stack:
        return None
    return out + stack[::-1]


def leading_expression(text: str) -> tuple[str, list[str], bool]:
    """The longest well-formed expression that ``text`` begins with, as text and in tokens, and whether it breaks off there (an
    operator or bracket follows that leads nowhere). A slash reads as "or"; prose, a dash, a comment's end or the end of a
    sentence end an expression."""
    tokens: list[str] = []
    good, good_end, depth, operand_due, broken = 0, 0, 0, True, False
    for match in _TAG_TOKEN.finditer(text):
        token, ends = match.group(), False
        word = "or" if token == "/" else token.lower()
        if word not in ("(", ")", "or", "and", "with"):
            name = token.rstrip(".:_-")
            ends = token[-1] in ".:"
            if not operand_due or not _identifier(name):
                break
            word, operand_due = name, False
        elif word == "(":
            if not operand_due:
                break
            depth += 1
        elif word == ")":
            if operand_due or not depth:
                break
            depth -= 1
        elif operand_due:
            break
        else:
            operand_due = True
        tokens.append(word)
        broken = True
        if not operand_due and not depth:
            good, broken = len(tokens), False
            good_end = match.start() + len(name) if word not in (")",) else match.end()
        if ends:
            break
    return text[:good_end].strip(), tokens[:good], broken


def _identifier(name: str) -> bool:
    """Licence identifiers are known, or have a digit, a dash or a capital letter; other words are prose."""
    return bool(name) and (family(name.lower()) in BURDEN or any(c.isdigit() or c.isupper() or c == "-" for c in name))


@lru_cache(maxsize=4096)
def family(identifier: str) -> str:
    """Label of a licence identifier: the longest known label that it starts with, else the identifier itself."""
    known = [x for x in BURDEN if identifier == x or identifier.startswith(x + "-")]
    return max(known, key=len) if known else identifier.rstrip("+")


def evaluate(postfix: list[str]) -> tuple[set[str], int]:
    """Labels named and the burden of the expression: the lighter side of "or", the heavier of "and".

    "with" adds an exception to a licence: it makes copyleft one step lighter, and the exception is no label."""
    stack: list[tuple[set[str], int]] = []
    for token in postfix:
        if token not in _PRECEDENCE:
            stack.append(({family(token)}, BURDEN.get(family(token), 4)))
            continue
        right, left = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left[0], left[1] - 1 if left[1] in (2, 3) else left[1]))
        else:
            stack.append((left[0] | right[0], (min if token == "or" else max)(left[1], right[1])))
    return stack[0]


class Scanner:
    """Automaton over notices and the words of the tags; one per task."""

    def __init__(self, base: dict[str, str], notices: dict[str, str], tags: tuple[str, ...]):
        self.base, self.tags, self.automaton = base, tags, ahocorasick.Automaton()
        kinds: dict[str, list[tuple[str, str]]] = {}
        for kind, entries in (("base", base), ("notice", notices)):
            for phrase, label in entries.items():
                kinds.setdefault(phrase, []).append((kind, label))
        for tag in tags:
            kinds.setdefault(" ".join(tag.encode().translate(ALNUM_WORDS).decode().split()), []).append(("tag", tag))
        for phrase, found in kinds.items():
            self.automaton.add_word(f" {phrase} ", (len(phrase), phrase.count(" ") + 1, found))
        self.automaton.make_automaton()

    def scan(self, raw: bytes) -> tuple:
        words = raw.translate(ALNUM_WORDS).split()
        if not words:
            return 0, 0, None, None, "", "", 0.0, [], [], None
        line = " " + b" ".join(words).decode("utf-8", "replace") + " "
        places, tagged = [], False
        base_starts, base_labels = [], set()
        at, word = 0, 0
        for end, (length, n, found) in self.automaton.iter(line):
            start = end - length
            word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            first = word - 1
            for kind, label in found:
                if kind == "tag":
                    tagged = True
                    continue
                places.append((first, first + n, label, kind))
                if kind == "base":
                    base_starts.append(first)
                    base_labels.add(label)
        expressions, malformed, labels, burden, doubt = [], [], set(base_labels), None, 1.0
        for text, kind in self._statements(raw, words, places, tagged):
            if kind == "tag":
                shown, tokens, broken = leading_expression(text)
                postfix = to_postfix(tokens)
                if postfix is None or broken:
                    malformed.append(text.strip())
            else:
                shown, postfix = " ".join(text), to_postfix(text)
                if postfix is None:
                    malformed.append(shown)
            if postfix is None:
                continue
            expressions.append(shown)
            named, weight = evaluate(postfix)
            labels |= named
            burden = max(burden or 0, weight)
            doubt *= 1 - WEIGHT[kind]
        return (len(words), len(base_starts), min(base_starts, default=None), max(base_starts, default=None),
                ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - doubt, expressions, malformed, burden)

    def _statements(self, raw: bytes, words: list[bytes], places: list[tuple], tagged: bool):
        if tagged:
            text = raw.decode("utf-8", "replace")
            for tag in self.tags:
                for match in re.finditer(re.escape(tag) + r"[ \t]*([A-Za-z0-9.+:_()/ \t-]+)", text, re.IGNORECASE):
                    yield match.group(1), "tag"
        places = sorted(set(places))
        starts = [p[0] for p in places]
        current: list[str] = []
        for k, (start, end, label, kind) in enumerate(places):
            if any(s <= start and e >= end and (s, e) != (start, end) for s, e, *_ in places[max(0, k - 4):k + 5]):
                continue                                       # a longer notice says more
            if not current:
                sure = kind
            current.append(label)
            after = bisect_right(starts, end - 1)
            joint = [w.decode() for w in words[end:starts[after]] if w in (b"or", b"and")] \
                if after < len(starts) and starts[after] - end <= 6 else []
            if len(joint) == 1:
                current.append(joint[0])
            else:
                yield current, sure
                current = []
        if current:
            yield (current[:-1] if current[-1] in _PRECEDENCE else current), sure


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict[str, str] | None = None,
         notices: dict[str, str] | None = None, tags: tuple[str, ...] = TAGS) -> DataFrame:
    """One row per document: base places and labels, all labels, score, the expressions read, and their burden."""
    base, notices = BASE_PHRASES if base is None else base, NOTICES if notices is None else notices
    chosen = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("raw"))
    id_type = chosen.schema["id"].dataType.simpleString()
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    kept: list[Scanner] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(Scanner(base, notices, tags))
        found = [kept[0].scan(raw.as_py()) for raw in batch.column(1)]
        types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()] + [pa.list_(pa.string())] * 2 + [pa.int32()]
        columns = [pa.array([row[k] for row in found], kind) for k, kind in enumerate(types)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])

    return map_batches(chosen, f"id {id_type}, {SCHEMA}", work).withColumnRenamed("id", id_col)
